"""Score-grid and goal-market queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrain.operators import grids, ledger
from matchgrain.plans.q_ledger import WALK_FORWARD
from matchgrain.plans.registry import query, rounded

SUMMARY = """SELECT fixture_id, count(*) AS cells, max(home_goals)::BIGINT AS max_goals, round(sum(p), 6) AS mass,
  round(sum(CASE WHEN home_goals > away_goals THEN p ELSE 0 END), 6) AS home_mass,
  round(sum(CASE WHEN home_goals = away_goals THEN p ELSE 0 END), 6) AS draw_mass,
  round(sum(p * home_goals), 6) AS mean_home, round(sum(p * away_goals), 6) AS mean_away,
  round(max(CASE WHEN home_goals = 1 AND away_goals = 0 THEN p END), 6) AS p_1_0
FROM {} GROUP BY fixture_id"""


def summary(grid):
    h, a, p = F.col("home_goals"), F.col("away_goals"), F.col("p")
    return rounded(
        grid.groupBy("fixture_id").agg(
            F.count(F.lit(1)).alias("cells"),
            F.max("home_goals").cast("bigint").alias("max_goals"),
            F.sum("p").alias("mass"),
            F.sum(F.when(h > a, p).otherwise(0.0)).alias("home_mass"),
            F.sum(F.when(h == a, p).otherwise(0.0)).alias("draw_mass"),
            F.sum(p * h).alias("mean_home"),
            F.sum(p * a).alias("mean_away"),
            F.max(F.when((h == 1) & (a == 0), p)).alias("p_1_0"),
        )
    )


@query("g1_poisson_grid", SUMMARY.format("grid"), "grid")
def g1(b):
    return summary(grids.poisson_grid(b.rates))


PAIR = """g AS (SELECT h.fixture_id, h.g AS home_goals, a.g AS away_goals, {p} AS p
  FROM pm h JOIN pm a ON a.fixture_id = h.fixture_id AND a.g <= {n} WHERE h.g <= {n})"""


@query(
    "g2_dixon_coles_grid",
    "WITH "
    + PAIR.format(
        n=12,
        p="""h.ph * a.pa * CASE WHEN h.g = 0 AND a.g = 0 THEN 1 + h.home_rate * h.away_rate * 0.08::DOUBLE
        WHEN h.g = 0 AND a.g = 1 THEN 1 - h.home_rate * 0.08::DOUBLE WHEN h.g = 1 AND a.g = 0 THEN 1 - h.away_rate * 0.08::DOUBLE
        WHEN h.g = 1 AND a.g = 1 THEN 1 + 0.08::DOUBLE ELSE 1 END""",
    )
    + SUMMARY.format("g"),
    "pm",
)
def g2(b):
    return summary(grids.dixon_coles_grid(b.rates.withColumn("rho", F.lit(-0.08))))


@query(
    "g3_bivariate_poisson_grid",
    """WITH g AS (SELECT fixture_id, h AS home_goals, a AS away_goals,
        exp(-(home_rate + away_rate - 0.2::DOUBLE)) * sum(pow(home_rate - 0.2::DOUBLE, h - s) * pow(away_rate - 0.2::DOUBLE, a - s) * pow(0.2::DOUBLE, s)
          / exp(lgamma(h - s + 1) + lgamma(a - s + 1) + lgamma(s + 1))) AS p
      FROM rates CROSS JOIN range(15) x(h) CROSS JOIN range(15) y(a) JOIN range(15) z(s) ON s <= least(h, a)
      GROUP BY fixture_id, home_rate, away_rate, h, a)"""
    + SUMMARY.format("g"),
    "rates",
)
def g3(b):
    return summary(grids.bivariate_poisson_grid(b.rates.withColumn("shared_rate", F.lit(0.2))))


@query(
    "g4_diagonal_inflated_grid",
    """WITH s AS (SELECT fixture_id, sum(p) AS m, sum(p * CASE WHEN home_goals = away_goals THEN 1.1::DOUBLE ELSE 1 END) AS n
        FROM grid GROUP BY fixture_id),
      g AS (SELECT fixture_id, home_goals, away_goals,
        p * CASE WHEN home_goals = away_goals THEN 1.1::DOUBLE ELSE 1 END * m / n AS p FROM grid JOIN s USING (fixture_id))"""
    + SUMMARY.format("g"),
    "grid",
)
def g4(b):
    return summary(grids.diagonal_inflated_grid(grids.poisson_grid(b.rates), 0.1))


@query(
    "g5_negative_binomial_grid",
    "WITH nb AS (SELECT fixture_id, k, "
    + ", ".join(
        f"exp(lgamma(k + 8) - lgamma(8) - lgamma(k + 1) + 8 * ln(8 / (8 + {r}_rate)) + k * ln({r}_rate / (8 + {r}_rate))) AS p{r[0]}"
        for r in ("home", "away")
    )
    + """ FROM rates CROSS JOIN range(21) t(k)),
      g AS (SELECT h.fixture_id, h.k AS home_goals, a.k AS away_goals, h.ph * a.pa AS p FROM nb h JOIN nb a USING (fixture_id))"""
    + SUMMARY.format("g"),
    "rates",
)
def g5(b):
    return summary(grids.negative_binomial_grid(b.rates.withColumn("dispersion", F.lit(8.0))))


@query(
    "g6_com_poisson_grid",
    "WITH w AS (SELECT fixture_id, k, "
    + ", ".join(f"exp(k * ln({r}_rate) - 1.2::DOUBLE * lgamma(k + 1)) AS w{r[0]}" for r in ("home", "away"))
    + """ FROM rates CROSS JOIN range(21) t(k)),
      n AS (SELECT *, wh / sum(wh) OVER p AS ph, wa / sum(wa) OVER p AS pa FROM w WINDOW p AS (PARTITION BY fixture_id)),
      g AS (SELECT h.fixture_id, h.k AS home_goals, a.k AS away_goals, h.ph * a.pa AS p FROM n h JOIN n a USING (fixture_id))"""
    + SUMMARY.format("g"),
    "rates",
)
def g6(b):
    return summary(grids.com_poisson_grid(b.rates.withColumn("dispersion", F.lit(1.2))))


def _ladder_sql() -> str:
    w = lambda c: f"round(sum(CASE WHEN {c} THEN p ELSE 0 END) / sum(p), 6)"
    h, d, a = w("home_goals > away_goals"), w("home_goals = away_goals"), w("home_goals < away_goals")
    raw = lambda c: f"sum(CASE WHEN {c} THEN p ELSE 0 END)"
    win, lose = raw("home_goals > away_goals"), raw("home_goals < away_goals")
    items = {
        "p_home": h, "p_draw": d, "p_away": a,
        "p_home_or_draw": w("home_goals >= away_goals"), "p_away_or_draw": w("home_goals <= away_goals"),
        "p_home_or_away": w("home_goals <> away_goals"),
        "p_btts_yes": w("home_goals > 0 AND away_goals > 0"), "p_btts_no": w("home_goals = 0 OR away_goals = 0"),
        "p_home_clean_sheet": w("away_goals = 0"), "p_away_clean_sheet": w("home_goals = 0"),
        "p_home_win_to_nil": w("home_goals > 0 AND away_goals = 0"),
        "p_away_win_to_nil": w("home_goals = 0 AND away_goals > 0"),
        "p_home_draw_no_bet": f"round({win} / ({win} + {lose}), 6)",
        "p_away_draw_no_bet": f"round({lose} / ({win} + {lose}), 6)",
    }
    for line in grids.LINES:
        tag = str(line).replace(".", "_")
        items[f"p_over_{tag}"] = w(f"home_goals + away_goals > {line}")
        items[f"p_under_{tag}"] = w(f"home_goals + away_goals < {line}")
        items[f"p_home_team_over_{tag}"] = w(f"home_goals > {line}")
        items[f"p_away_team_over_{tag}"] = w(f"away_goals > {line}")
    body = ", ".join(f"{sql} AS {name}" for name, sql in items.items())
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY round(p, 12) DESC, home_goals, away_goals) AS rk FROM grid)
    SELECT fixture_id, {body}, max(CASE WHEN rk = 1 THEN home_goals || '-' || away_goals END) AS most_likely_score
    FROM r GROUP BY fixture_id"""


@query("g7_goal_market_ladder", _ladder_sql(), "grid")
def g7(b):
    return rounded(grids.goal_market_ladder(grids.poisson_grid(b.rates)))


@query(
    "g8_closed_form_goal_markets",
    "SELECT fixture_id, round(home_rate + away_rate, 6) AS ExpectedTotalGoals, "
    + ", ".join(
        f"round(1 - {u}, 6) AS Over{t}_5Prob, round({u}, 6) AS Under{t}_5Prob"
        for t in range(4)
        for u in [
            "exp(-(home_rate + away_rate)) * ("
            + " + ".join(f"pow(home_rate + away_rate, {g}) / factorial({g})" for g in range(t + 1))
            + ")"
        ]
    )
    + """, round(1 - exp(-home_rate) - exp(-away_rate) + exp(-(home_rate + away_rate)), 6) AS BTTSYesProb,
    round(exp(-home_rate) + exp(-away_rate) - exp(-(home_rate + away_rate)), 6) AS BTTSNoProb,
    (SELECT arg_max(g, (round(ph, 12), -g)) FROM pm WHERE pm.fixture_id = rates.fixture_id AND g <= 10) || '-' ||
    (SELECT arg_max(g, (round(pa, 12), -g)) FROM pm WHERE pm.fixture_id = rates.fixture_id AND g <= 10) AS MostLikelyScore
    FROM rates""",
    "pm",
)
def g8(b):
    return rounded(b.rates.select("fixture_id", *[c.alias(n) for n, c in grids.closed_form_goal_markets("home_rate", "away_rate").items()]))


@query(
    "g9_grid_bounds",
    """WITH s AS (SELECT fixture_id, sum(p) AS m, sum(CASE WHEN home_goals > away_goals THEN p ELSE 0 END) AS h,
        sum(CASE WHEN home_goals = away_goals THEN p ELSE 0 END) AS d, sum(CASE WHEN home_goals < away_goals THEN p ELSE 0 END) AS a,
        sum(CASE WHEN home_goals > 0 AND away_goals > 0 THEN p ELSE 0 END) AS bt, sum(p * home_goals) AS gh, sum(p * away_goals) AS ga
      FROM grid GROUP BY fixture_id)
    SELECT fixture_id, round(m, 6) AS represented_mass, round(greatest(0, 1 - m), 6) AS tail_mass, round(h, 6) AS home_lower,
      round(d, 6) AS draw_lower, round(a, 6) AS away_lower, round(bt, 6) AS btts_lower, round(gh, 6) AS home_goals_lower,
      round(ga, 6) AS away_goals_lower, round(h + 1 - m, 6) AS home_upper, round(d + 1 - m, 6) AS draw_upper,
      round(a + 1 - m, 6) AS away_upper, round(h / (h + d + a), 6) AS p_home, round(d / (h + d + a), 6) AS p_draw,
      round(a / (h + d + a), 6) AS p_away FROM s""",
    "grid",
)
def g9(b):
    return rounded(grids.grid_bounds(grids.poisson_grid(b.rates)))


@query(
    "g10_scoreline_ignorance",
    """SELECT r.fixture_id, round(-ln(greatest(g.p, 1e-15)), 6) AS ignorance FROM rates r
       JOIN grid g ON g.fixture_id = r.fixture_id AND g.home_goals = r.home_goals AND g.away_goals = r.away_goals""",
    "grid",
)
def g10(b):
    return rounded(grids.scoreline_ignorance(grids.poisson_grid(b.rates), b.rates))


def _leg(cond_win: str, cond_void: str) -> str:
    return f"CASE WHEN {cond_win} THEN price - 1 WHEN {cond_void} THEN 0 ELSE -1 END"


def _settle_sql(margin: str) -> str:
    legs = []
    for sign in ("-", "+"):
        m = margin.format(line=f"(line {sign} half)")
        legs.append(_leg(f"{m} > 0", f"{m} = 0"))
    return f"(({legs[0]}) + ({legs[1]})) / 2"


@query(
    "g11_settle_asian_lines",
    f"""WITH x AS (SELECT *, CASE WHEN abs(line * 4)::BIGINT % 2 = 1 THEN 0.25 ELSE 0 END::DOUBLE AS half FROM (
        SELECT fixture_id, home_goals AS h, away_goals AS a, ((fixture_id % 13) / 4.0 + 0.5)::DOUBLE AS line,
               (1.5 + (fixture_id % 20) / 10.0)::DOUBLE AS price FROM completed))
    SELECT fixture_id, line, round({_settle_sql("(h + a - {line})")}, 6) AS over_return,
      round({_settle_sql("({line} - h - a)")}, 6) AS under_return,
      round({_settle_sql("(h - a + {line} - 2)")}, 6) AS handicap_return FROM x""",
    "completed",
)
def g11(b):
    rows = b.completed.select(
        "fixture_id", "home_goals", "away_goals",
        ((F.col("fixture_id") % 13) / 4.0 + 0.5).alias("line"),
        (F.lit(1.5) + (F.col("fixture_id") % 20) / 10.0).alias("price"),
    )
    total = F.col("home_goals") + F.col("away_goals")
    out = rows.select(
        "fixture_id", "line",
        grids.over_net_return(total, "line", "price").cast("double").alias("over_return"),
        grids.under_net_return(total, "line", "price").cast("double").alias("under_return"),
        grids.handicap_net_return("home_goals", "away_goals", F.col("line") - 2, "price").cast("double").alias("handicap_return"),
    )
    return rounded(out)


@query(
    "g12_expected_net_return",
    f"""WITH l AS (SELECT fixture_id, (1.5 + (fixture_id % 9) / 4.0)::DOUBLE AS line, 1.9::DOUBLE AS price FROM rates),
      x AS (SELECT g.*, line, price, CASE WHEN abs(line * 4)::BIGINT % 2 = 1 THEN 0.25 ELSE 0 END::DOUBLE AS half FROM grid g JOIN l USING (fixture_id))
    SELECT fixture_id, line, price, round(sum(p * ({_settle_sql("(home_goals + away_goals - {line})")})), 6) AS expected_net_return
    FROM x GROUP BY fixture_id, line, price""",
    "grid",
)
def g12(b):
    lines = b.rates.select(
        "fixture_id", (F.lit(1.5) + (F.col("fixture_id") % 9) / 4.0).alias("line"), F.lit(1.9).alias("price")
    )
    return rounded(grids.expected_over_net_return(grids.poisson_grid(b.rates), lines))


@query(
    "g13_score_matrix_long",
    """SELECT fixture_id, h.g AS home_goals, """
    + ", ".join(f"round(h.ph * max(CASE WHEN a.g = {k} THEN a.pa END), 6) AS a{k}" for k in range(6))
    + """ FROM pm h JOIN pm a USING (fixture_id) WHERE h.g <= 5 AND a.g <= 5 GROUP BY fixture_id, h.g, h.ph""",
    "pm",
)
def g13(b):
    wide = grids.grid_to_wide(grids.fixed_poisson_grid(b.rates, max_goals=5), 5)
    return rounded(wide.withColumn("home_goals", F.col("home_goals").cast("bigint")))


@query(
    "g13_score_matrix_round_trip",
    "SELECT fixture_id, h.g AS home_goals, a.g AS away_goals, round(h.ph * a.pa, 6) AS p FROM pm h JOIN pm a USING (fixture_id) WHERE h.g <= 3 AND a.g <= 3",
    "pm",
)
def g13_back(b):
    wide = grids.grid_to_wide(grids.fixed_poisson_grid(b.rates, max_goals=3), 3)
    return rounded(grids.wide_to_grid(wide, 3).select("fixture_id", "home_goals", "away_goals", "p"))


def walk_forward(b):
    rates = ledger.walk_forward_rates(b.matches).select("fixture_id", "home_rate", "away_rate")
    return rates.join(grids.one_x_two(grids.fixed_poisson_grid(rates, max_goals=10)), "fixture_id")


@query(
    "w12_walk_forward_poisson",
    f"""WITH {WALK_FORWARD}, c AS (SELECT fixture_id, h, a, exp(h * ln(home_rate) - home_rate - lgamma(h + 1)) * exp(a * ln(away_rate) - away_rate - lgamma(a + 1)) AS p
      FROM wf CROSS JOIN range(11) x(h) CROSS JOIN range(11) y(a)),
    o AS (SELECT fixture_id, sum(p) AS m, sum(CASE WHEN h > a THEN p ELSE 0 END) AS hw, sum(CASE WHEN h = a THEN p ELSE 0 END) AS d, sum(CASE WHEN h < a THEN p ELSE 0 END) AS aw FROM c GROUP BY 1)
    SELECT fixture_id, round(home_rate, 6) AS home_rate, round(away_rate, 6) AS away_rate, round(hw / m, 6) AS p_home, round(d / m, 6) AS p_draw, round(aw / m, 6) AS p_away FROM wf JOIN o USING (fixture_id)""",
    "matches",
)
def w12(b):
    return rounded(walk_forward(b))


FRAME = """WITH t AS (SELECT f.*, m.home_team_id, m.away_team_id, p_home + p_draw + p_away AS s, r.home_rate, r.away_rate
      FROM forecasts f JOIN matches m USING (fixture_id) JOIN rates r USING (fixture_id)),
    u AS (SELECT *, greatest(p_home, p_draw, p_away) AS lead,
      p_home + p_draw + p_away - greatest(p_home, p_draw, p_away) - least(p_home, p_draw, p_away) AS second FROM t),
    v AS (SELECT *, 100 * (1 - greatest(0, least(1, (0.7::DOUBLE * lead + 0.3::DOUBLE * (lead - second) - 0.7::DOUBLE / 3) / (1 - 0.7::DOUBLE / 3)))) AS risk,
      CASE WHEN p_home = lead THEN 'Home' WHEN p_draw = lead THEN 'Draw' ELSE 'Away' END AS side FROM u) """


@query(
    "v18_prediction_frame",
    FRAME
    + """SELECT fixture_id, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away, side AS prediction,
      CASE side WHEN 'Home' THEN home_team_id WHEN 'Away' THEN away_team_id END AS lean_team_id, round(risk, 6) AS risk_score,
      CASE WHEN risk <= 60 THEN 'Low Risk' WHEN risk <= 80 THEN 'Moderate Risk' WHEN risk <= 92 THEN 'High Risk' ELSE 'Critical Risk' END AS risk_band,
      CASE WHEN lead >= 0.65 AND risk <= 60 THEN 'Strong ' || side || ' Lean' WHEN lead >= 0.55 AND risk <= 80 THEN 'Consider ' || side ELSE 'No Clear Edge' END AS guidance,
      'No bet' AS recommendation, round(1 - exp(-home_rate) - exp(-away_rate) + exp(-(home_rate + away_rate)), 6) AS BTTSYesProb
    FROM v""",
    "forecasts rates",
)
def v18(b):
    from matchgrain.operators.evaluation import prediction_frame

    f = b.forecasts.select("fixture_id", "p_home", "p_draw", "p_away").join(
        b.matches.select("fixture_id", "home_team_id", "away_team_id"), "fixture_id"
    ).join(b.rates.select("fixture_id", "home_rate", "away_rate"), "fixture_id")
    return rounded(
        prediction_frame(f).select(
            "fixture_id", "p_home", "p_draw", "p_away", "prediction", "lean_team_id", "risk_score", "risk_band",
            "guidance", "recommendation", "BTTSYesProb",
        )
    )
