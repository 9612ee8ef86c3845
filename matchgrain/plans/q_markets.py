"""Market and forecast-evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrain.operators import evaluation as V
from matchgrain.operators import markets as M
from matchgrain.plans.registry import query, rounded


@query("m1_devig_multiplicative", "SELECT fixture_id, market, selection, bookmaker, observed_at, round(decimal_price, 6) AS decimal_price, round(fair_probability, 6) AS fair_probability FROM fair", "fair")
def m1(b):
    return rounded(M.devig_multiplicative(b.quotes))


@query("m2_devig_power")
def m2(b):
    return rounded(M.devig_solved(b.quotes, "power"), 9)


@query("m3_devig_shin")
def m3(b):
    return rounded(M.devig_solved(b.quotes, "shin"), 9)


@query("m4_market_implied_goals")
def m4(b):
    return M.market_implied_goals(b.forecasts)


@query("m5_closing_line_audit", """WITH f AS (SELECT fixture_id, market, selection, bookmaker, min(observed_at) AS accepted_observed_at, arg_min(decimal_price, observed_at) AS accepted_price, max(observed_at) AS closing_observed_at, arg_max(decimal_price, observed_at) AS closing_price FROM quotes GROUP BY ALL)
  SELECT fixture_id, market, selection, bookmaker, accepted_observed_at, round(accepted_price, 6) AS accepted_price, closing_observed_at, round(closing_price, 6) AS closing_price, CASE WHEN closing_observed_at > accepted_observed_at THEN round(ln(accepted_price / closing_price), 6) END AS clv, CASE WHEN closing_observed_at > accepted_observed_at THEN 'covered' ELSE 'close_not_later' END AS coverage, 'latest_same_source_before_kickoff' AS method FROM f""", "quotes")
def m5(b):
    keys = ["fixture_id", "market", "selection", "bookmaker"]
    first = b.quotes.groupBy(*keys).agg(F.min("observed_at").alias("observed_at"), F.min_by("decimal_price", "observed_at").alias("decimal_price"))
    return rounded(M.closing_line_audit(first, b.quotes, b.matches))


ASSESS = "1 / model_probability AS fair_price, model_probability - market_probability AS edge, model_probability * decimal_price - 1 AS expected_return"


@query("m6_assess_market", "SELECT fixture_id, bookmaker, round(1 / model_probability, 6) AS fair_price, round(model_probability - market_probability, 6) AS edge, round(model_probability * decimal_price - 1, 6) AS expected_return FROM opportunities", "opportunities")
def m6(b):
    return rounded(M.assess_market(b.opportunities).select("fixture_id", "bookmaker", "fair_price", "edge", "expected_return"))


KELLY = """st AS (SELECT *, CASE WHEN quote_is_fresh AND uncertainty_passed AND calibration_passed AND model_probability - market_probability >= 0.03 AND model_probability * decimal_price - 1 >= 0.02
   THEN least(0.01::DOUBLE, 0.25::DOUBLE * greatest(0, (model_probability * decimal_price - 1) / (decimal_price - 1))) ELSE 0 END AS f FROM opportunities)"""


@query("m7_kelly_stake", f"WITH {KELLY} SELECT fixture_id, bookmaker, round(f, 6) AS stake_fraction FROM st", "opportunities")
def m7(b):
    return rounded(M.kelly_stake(b.opportunities).select("fixture_id", "bookmaker", "stake_fraction"))


@query("w20_bankroll_backtest", f"""WITH {KELLY}, g AS (SELECT *, ln(1 + f * CASE WHEN won THEN decimal_price - 1 ELSE -1 END - f * 0.01) AS lg FROM st WHERE won IS NOT NULL),
   s AS (SELECT *, sum(lg) OVER w AS after, coalesce(sum(lg) OVER (PARTITION BY league_id, bookmaker ORDER BY kickoff_utc, fixture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WINDOW w AS (PARTITION BY league_id, bookmaker ORDER BY kickoff_utc, fixture_id)),
   p AS (SELECT *, greatest(0, max(after) OVER (PARTITION BY league_id, bookmaker ORDER BY kickoff_utc, fixture_id)) AS top FROM s)
  SELECT fixture_id, bookmaker, round(1000 * exp(after), 4) AS bankroll, round(1000 * exp(before) * f, 4) AS stake, round(1000 * exp(after) - 1000 * exp(before), 4) AS profit, round(1 - exp(after - top), 4) AS drawdown FROM p""", "opportunities")
def w20(b):
    out = M.bankroll_backtest(b.opportunities, keys=["league_id", "bookmaker"], cost=0.01)
    return rounded(out.select("fixture_id", "bookmaker", "bankroll", "stake", "profit", "drawdown"), 4)


@query("w21_exposure_caps")
def w21(b):
    return M.exposure_caps(b.opportunities, tie=["fixture_id", "bookmaker"]).select("fixture_id", "bookmaker", "league_id", "team_id", "stake_fraction", "allocation_reason")


@query("m8_backtest_summary")
def m8(b):
    ledger = M.bankroll_backtest(b.opportunities, keys=["league_id", "bookmaker"]).withColumn("season_id", F.year("kickoff_utc"))
    from matchgrain.functions.storage import cut_lineage

    return M.backtest_summary(cut_lineage(ledger), groups=["season_id", "bookmaker"])


ROWS = """r AS (SELECT *, -ln(greatest(CASE target WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END, 1e-15)) AS ll,
   pow(p_home - (target = 0)::INT, 2) + pow(p_draw - (target = 1)::INT, 2) + pow(p_away - (target = 2)::INT, 2) AS br,
   (pow(p_home - (target = 0)::INT, 2) + pow(p_home + p_draw - (target <= 1)::INT, 2)) / 2 AS rps, greatest(p_home, p_draw, p_away) AS top,
   CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 0 WHEN p_draw >= p_away THEN 1 ELSE 2 END AS lead FROM scored)"""
PANEL = "round(avg(ll), 6) AS log_loss, round(avg(br), 6) AS brier, round(avg(rps), 6) AS rps, round(avg((lead = target)::INT), 6) AS accuracy, round(avg((lead = 1)::INT) FILTER (WHERE target = 1), 6) AS draw_recall"


@query("v1_proper_scores", f"WITH {ROWS} SELECT model_id, count(*) AS fixtures, {PANEL} FROM r GROUP BY model_id", "scored")
def v1(b):
    return rounded(V.proper_scores(b.scored))


@query("v2_probability_metrics", f"""WITH {ROWS}, e AS (SELECT model_id, sum(n * abs(p - o)) / sum(n) AS ece FROM (SELECT model_id, least(floor(round(top, 9) * 10), 9) AS bn, count(*) AS n, avg(top) AS p, avg((lead = target)::INT) AS o FROM r GROUP BY ALL) GROUP BY 1)
  SELECT r.model_id, count(*) AS fixtures, round(avg(ll), 6) AS log_loss, round(avg(br), 6) AS brier, round(avg((lead = target)::INT), 6) AS accuracy, round(coalesce(avg((lead = 1)::INT) FILTER (WHERE target = 1), 0), 6) AS draw_recall,
   round(avg(top), 6) AS mean_confidence, round(avg((top >= 0.55)::INT), 6) AS decisive_lean_rate, round(any_value(ece), 6) AS calibration_error FROM r JOIN e USING (model_id) GROUP BY 1""", "scored")
def v2(b):
    return rounded(V.probability_metrics(b.scored))


#: The fit by means: a level ends where the mean from its first forecast on is lowest, last of equals.
@query("v3_reliability_curve", """WITH RECURSIVE d AS (SELECT p_home AS p, sum((target = 0)::INT)::DOUBLE AS y, count(*)::DOUBLE AS w FROM scored GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY p) AS i, p, w, sum(y) OVER (ORDER BY p) AS cy, sum(w) OVER (ORDER BY p) AS cw FROM d),
   r(lo, y0, w0, hi, y1, w1) AS (SELECT 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::BIGINT, 0::DOUBLE, 0::DOUBLE UNION ALL
     SELECT hi, y1, w1, b.i, b.cy, b.cw FROM (SELECT r.hi, r.y1, r.w1, max(struct_pack(s := -(c.cy - r.y1) / (c.cw - r.w1), i := c.i, cy := c.cy, cw := c.cw)) AS b FROM r JOIN c ON c.i > r.hi GROUP BY ALL))
  SELECT round((y1 - y0) / (w1 - w0), 6) AS fitted_rate, round((SELECT sum(p * w) / sum(w) FROM c WHERE c.i > r.lo AND c.i <= r.hi), 6) AS forecast_mean, round((y1 - y0) / (w1 - w0), 6) AS observed_rate, (w1 - w0)::BIGINT AS count FROM r WHERE hi > 0""", "scored")
def v3(b):
    return rounded(V.reliability_curve(b.scored.withColumn("y", F.col("target") == 0), "p_home", "y"))


@query("v4_expected_calibration_error", """SELECT model_id, round(sum(n * abs(p - o)) / sum(n), 6) AS ece FROM (SELECT model_id, least(floor(p_home * 10), 9) AS bn, count(*) AS n, avg(p_home) AS p, avg((target = 0)::INT) AS o FROM scored GROUP BY ALL) GROUP BY 1""", "scored")
def v4(b):
    return rounded(V.expected_calibration_error(b.scored.withColumn("y", F.col("target") == 0), "p_home", "y", ["model_id"]))


COHORT = f"""{ROWS}, mx AS (SELECT max(kickoff_utc) AS k FROM scored), c AS (SELECT r.*, unnest(list_distinct(list_filter(['edition:' || edition_id, CASE WHEN d <= 90 THEN 'rolling_90d' END, CASE WHEN d <= 180 THEN 'rolling_180d' END, CASE WHEN d <= 365 THEN 'rolling_365d' END,
   'season:established', 'history:full_history', CASE WHEN p_home >= 0.55 THEN 'favorite:home' WHEN p_away >= 0.55 THEN 'favorite:away' ELSE 'favorite:balanced' END, 'schedule:normal_rest', 'phase:regular', 'coverage:full',
   'confidence_decile:' || ((top > 0.1)::INT + (top > 0.2)::INT + (top > 0.3)::INT + (top > 0.4)::INT + (top > 0.5)::INT + (top > 0.6)::INT + (top > 0.7)::INT + (top > 0.8)::INT + (top > 0.9)::INT)], lambda x: x IS NOT NULL))) AS cohort
   FROM (SELECT r.*, (epoch(k) - epoch(kickoff_utc)) / 86400 AS d FROM r, mx) r)"""


@query("v5_assign_cohorts", f"WITH {COHORT} SELECT fixture_id, cohort FROM c", "scored")
def v5(b):
    return V.assign_cohorts(b.scored).select("fixture_id", "cohort")


@query("v6_cohort_metrics", f"""WITH {COHORT} SELECT cohort, count(*) AS n, CASE WHEN count(*) >= 20 THEN 'available' ELSE 'insufficient_sample' END AS status, CASE WHEN count(*) >= 20 THEN round(avg(ll), 6) END AS log_loss, CASE WHEN count(*) >= 20 THEN round(avg(br), 6) END AS brier,
   CASE WHEN count(*) >= 20 THEN round(avg(rps), 6) END AS rps, CASE WHEN count(*) >= 20 THEN round(avg((lead = target)::INT), 6) END AS accuracy, CASE WHEN count(*) >= 20 THEN round(avg((lead = 1)::INT) FILTER (WHERE target = 1), 6) END AS draw_recall,
   CASE WHEN count(*) >= 20 THEN round(stddev_samp(br) / sqrt(count(*)), 6) END AS standard_error_brier FROM c GROUP BY 1""", "scored")
def v6(b):
    return rounded(V.cohort_metrics(V.assign_cohorts(b.scored)))


@query("v7_population_stability_index", """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM events WHERE ts < TIMESTAMP '2024-01-15'),
   c AS (SELECT len(list_filter(q[2:len(q) - 1], lambda x: x <= value)) AS bn, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS r, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS n FROM events, e GROUP BY 1),
   s AS (SELECT greatest(r / sum(r) OVER (), 1e-6) AS r, greatest(n / sum(n) OVER (), 1e-6) AS n FROM c), p AS (SELECT sum((n - r) * ln(n / r)) AS psi FROM s)
  SELECT round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'watch' ELSE 'action_required' END AS severity FROM p""")
def v7(b):
    e, cut = b.table("events"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return rounded(V.population_stability_index(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), "value"))


def losses(b):
    """Log losses of the forecast, the uniform forecast and a flattened forecast."""
    s = b.scored.withColumns(V.row_scores())
    flat = V.apply_temperature(b.scored, 2.0).withColumns(V.row_scores()).select("fixture_id", F.col("_log_loss").alias("flat"))
    return s.select("fixture_id", "kickoff_utc", F.col("_log_loss").alias("model"), F.lit(1.0986122886681098).alias("uniform")).join(flat, "fixture_id")


@query("v8_paired_block_interval")
def v8(b):
    return V.paired_block_interval(losses(b), "model", "uniform", block_length=8)


@query("v9_reality_check")
def v9(b):
    rows = losses(b).select("fixture_id", "kickoff_utc", (F.col("model") - F.col("uniform")).alias("a1"), (F.col("model") - F.col("flat")).alias("a2"))
    return V.reality_check(rows, ["a1", "a2"], block_length=8)


@query("v10_release_gate")
def v10(b):
    champion = b.scored.withColumn("cohort", F.col("edition_id"))
    return V.release_gate(champion, V.apply_temperature(b.scored, 3.0), champion_id="m", challenger_id="m_flat", coherence_passed=True, operations_passed=True)


@query("v11_select_half_life", """WITH s AS (SELECT h AS half_life, year(kickoff_utc) AS fold, avg(pow(p_home - (target = 0)::INT, 2) * (1 + abs(h - 300) / 1000.0)) AS score FROM scored CROSS JOIN (VALUES (90.0), (365.0), (730.0)) v(h) GROUP BY ALL), m AS (SELECT half_life, avg(score) AS mean_score FROM s GROUP BY 1)
  SELECT arg_min(half_life, mean_score)::DOUBLE AS half_life, round(min(mean_score), 6) AS mean_score FROM m""", "scored")
def v11(b):
    h = F.col("half_life")
    rows = b.scored.withColumn("half_life", F.explode(F.array(F.lit(90.0), F.lit(365.0), F.lit(730.0))))
    loss = F.pow(F.col("p_home") - (F.col("target") == 0).cast("int"), F.lit(2)) * (1 + F.abs(h - 300) / 1000.0)
    return rounded(V.select_half_life(rows.groupBy("half_life", F.year("kickoff_utc").alias("fold")).agg(F.avg(loss).alias("score"))))


@query("v12_temperature_scaling", """WITH t AS (SELECT 0.25::DOUBLE + i * 0.125::DOUBLE AS t FROM range(31) r(i)), l AS (SELECT t, avg(-ln(pow(CASE target WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END, 1 / t) / (pow(p_home, 1 / t) + pow(p_draw, 1 / t) + pow(p_away, 1 / t)))) AS l FROM scored, t GROUP BY t), b AS (SELECT arg_min(t, l) AS t FROM l),
   t2 AS (SELECT least(4, greatest(0.25, b.t + i * 0.0125::DOUBLE)) AS t FROM b, range(-10, 11) r(i)), l2 AS (SELECT t, avg(-ln(pow(CASE target WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END, 1 / t) / (pow(p_home, 1 / t) + pow(p_draw, 1 / t) + pow(p_away, 1 / t)))) AS l FROM scored, t2 GROUP BY t), b2 AS (SELECT arg_min(t, l) AS t FROM l2),
   t3 AS (SELECT least(4, greatest(0.25, b2.t + i * 0.00125::DOUBLE)) AS t FROM b2, range(-10, 11) r(i)), l3 AS (SELECT t, avg(-ln(pow(CASE target WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END, 1 / t) / (pow(p_home, 1 / t) + pow(p_draw, 1 / t) + pow(p_away, 1 / t)))) AS l FROM scored, t3 GROUP BY t)
  SELECT round(arg_min(t, l), 6) AS temperature FROM l3""", "scored")
def v12(b):
    return rounded(V.fit_temperature(b.scored))


def draws(b, n: int = 9):
    """Bootstrap-like draws around each forecast, from a hash."""
    u = lambda s: F.lit(0.5) + F.pmod(F.col("fixture_id") * F.lit(s) + F.col("draw") * F.lit(s + 4), F.lit(97)) / 97.0
    rows = b.scored.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.select("fixture_id", "draw", *[(F.col(c) * u(s)).alias(c) for c, s in (("p_home", 7), ("p_draw", 11), ("p_away", 13))])


DRAWS = """d AS (SELECT fixture_id, draw, """ + ", ".join(f"p_{o} * (0.5 + (fixture_id * {s} + draw * {s + 4}) % 97 / 97.0) AS {o[0]}" for o, s in (("home", 7), ("draw", 11), ("away", 13))) + """ FROM scored CROSS JOIN range(1, 10) t(draw)),
   n AS (SELECT fixture_id, draw, h / (h + d + a) AS h, d.d / (h + d.d + a) AS dd, a / (h + d.d + a) AS a FROM d)"""
DRAWS = DRAWS.replace("h / (h + d + a) AS h", "h / (h + d.d + a) AS h")


@query("v13_forecast_intervals", f"""WITH {DRAWS}, l AS (SELECT fixture_id, draw, unnest([0, 1, 2]) AS outcome, unnest([h, dd, a]) AS p, CASE WHEN h >= dd AND h >= a THEN 0 WHEN dd >= a THEN 1 ELSE 2 END AS lead FROM n),
   q AS (SELECT fixture_id, outcome, quantile_cont(p, 0.1) AS l8, quantile_cont(p, 0.25) AS l5, median(p) AS m, quantile_cont(p, 0.75) AS u5, quantile_cont(p, 0.9) AS u8 FROM l GROUP BY ALL), pt AS (SELECT fixture_id, arg_max(outcome, (m, -outcome)) AS pl FROM q GROUP BY 1),
   st AS (SELECT l.fixture_id, avg((lead = pl)::INT) AS s FROM l JOIN pt USING (fixture_id) GROUP BY 1)
  SELECT q.fixture_id, outcome, round(l8, 6) AS lower_80, round(l5, 6) AS lower_50, round(m, 6) AS median, round(u5, 6) AS upper_50, round(u8, 6) AS upper_80, round(s, 6) AS leader_stability FROM q JOIN st USING (fixture_id)""", "scored")
def v13(b):
    return rounded(V.forecast_intervals(draws(b)))


@query("v13_interval_coverage")
def v13_cov(b):
    return V.interval_coverage(V.forecast_intervals(draws(b)), b.scored.select("fixture_id", "target"))


@query("v17_binary_market_calibration", """WITH l AS (SELECT model_id, edition_id, unnest(['over_2_5', 'btts']) AS market, unnest([1 - exp(-t) * (1 + t + t * t / 2), 1 - exp(-home_rate) - exp(-away_rate) + exp(-t)]) AS p, unnest([(r.home_goals + r.away_goals > 2)::INT, (r.home_goals > 0 AND r.away_goals > 0)::INT]) AS y
      FROM (SELECT *, home_rate + away_rate AS t FROM rates) r JOIN scored USING (fixture_id)),
   e AS (SELECT model_id, edition_id, market, sum(n * abs(p - y)) / sum(n) AS ece FROM (SELECT model_id, edition_id, market, least(floor(p * 10), 9) AS bn, count(*) AS n, avg(p) AS p, avg(y) AS y FROM l GROUP BY ALL) GROUP BY ALL)
  SELECT model_id, edition_id, market, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(any_value(ece), 6) AS ece FROM l JOIN e USING (model_id, edition_id, market) GROUP BY ALL""", "rates scored")
def v17(b):
    from matchgrain.operators.grids import closed_form_goal_markets

    m = closed_form_goal_markets("home_rate", "away_rate")
    r = b.rates.where("home_goals IS NOT NULL").select(
        "fixture_id", m["Over2_5Prob"].alias("p_over"), m["BTTSYesProb"].alias("p_btts"), (F.col("home_goals") + F.col("away_goals") > 2).alias("y_over"),
        ((F.col("home_goals") > 0) & (F.col("away_goals") > 0)).alias("y_btts"),
    ).join(b.scored.select("fixture_id", "model_id", "edition_id"), "fixture_id")
    return rounded(V.binary_market_calibration(r, {"over_2_5": ("p_over", "y_over"), "btts": ("p_btts", "y_btts")}))


@query("v19_feature_set_comparison", f"""WITH {ROWS}, s AS (SELECT year(kickoff_utc) AS fold, avg(ll) AS a, avg(br) AS b FROM r GROUP BY 1)
  SELECT round(avg(a), 6) AS mean_a, round(stddev_pop(a), 6) AS std_a, round(avg(b), 6) AS mean_b, round(stddev_pop(b), 6) AS std_b, round(avg(b - a), 6) AS delta, round(avg(b - a) / (stddev_samp(b - a) / sqrt(count(*))), 5) AS t_statistic FROM s""", "scored")
def v19(b):
    s = b.scored.withColumns(V.row_scores()).groupBy(F.year("kickoff_utc").alias("fold")).agg(F.avg("_log_loss").alias("score_a"), F.avg("_brier").alias("score_b"))
    return rounded(V.feature_set_comparison(s)).withColumn("t_statistic", F.round("t_statistic", 5))


@query("v19_class_report", f"""WITH {ROWS} SELECT c AS class, round(coalesce(avg((lead = target)::INT) FILTER (WHERE lead = c), 0), 6) AS precision, round(coalesce(avg((lead = target)::INT) FILTER (WHERE target = c), 0), 6) AS recall, count(*) FILTER (WHERE target = c) AS support FROM r CROSS JOIN (VALUES (0), (1), (2)) v(c) GROUP BY c""", "scored")
def v19_class(b):
    s = b.scored.withColumn("prediction", V.row_scores()["_lead"].cast("int"))
    return rounded(V.class_report(s))
