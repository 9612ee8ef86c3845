"""Window, ranking, ledger and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrain.operators import ledger, ledgers
from matchgrain.operators import windows as W
from matchgrain.plans.q_joins import pools
from matchgrain.plans.registry import query, rounded


@query("w6_revision_deltas", """WITH i AS (SELECT fixture_id, kickoff_utc, observed_at AS issued_at, bookmaker AS model_id, fair_probability AS p FROM fair JOIN matches USING (fixture_id) WHERE selection = 'home')
  SELECT fixture_id, issued_at, model_id, round(p - lag(p) OVER (PARTITION BY fixture_id ORDER BY issued_at, model_id), 6) AS delta_p_home,
   CASE WHEN epoch(kickoff_utc) - epoch(issued_at) >= 604800 THEN 'initial' WHEN epoch(kickoff_utc) - epoch(issued_at) >= 86400 THEN '24_hour' ELSE 'lineup' END AS revision_label FROM i""", "fair matches")
def w6(b):
    from matchgrain.operators.markets import devig_multiplicative

    i = devig_multiplicative(b.quotes).where("selection = 'home'").join(b.matches.select("fixture_id", "kickoff_utc"), "fixture_id").select(
        "fixture_id", "kickoff_utc", F.col("observed_at").alias("issued_at"), F.col("bookmaker").alias("model_id"), F.col("fair_probability").alias("p_home")
    )
    return rounded(W.revision_deltas(i).select("fixture_id", "issued_at", "model_id", "delta_p_home", "revision_label"))


TABLE = "t AS (SELECT edition_id, team_id, sum(points) AS points, sum(goals_for)::BIGINT AS goals_for, sum(goals_against)::BIGINT AS goals_against FROM events2 WHERE goals_for IS NOT NULL GROUP BY ALL)"


def pct(column: str, part: str = "", desc: str = "") -> str:
    p = f"PARTITION BY {part}" if part else ""
    ties = ", ".join(x for x in (part, column) if x)
    return f"((rank() OVER ({p} ORDER BY {column} {desc}) + (count(*) OVER (PARTITION BY {ties}) - 1) / 2.0) / count({column}) OVER ({p}))"


@query("w7_percentile_rank", f"WITH {TABLE} SELECT edition_id, team_id, round({pct('points', 'edition_id')}, 6) AS points_pct, round({pct('goals_for', 'edition_id')}, 6) AS goals_for_pct FROM t", "events2")
def w7(b):
    t = ledger.league_table(b.matches)
    return rounded(W.percentile_comparison(t, ["points", "goals_for"], group=["edition_id"]).select("edition_id", "team_id", "points_pct", "goals_for_pct"))


@query("w8_style_labels", f"""WITH {TABLE}, p AS (SELECT edition_id, team_id, {pct('goals_for', 'edition_id')} AS t, {pct('goals_against', 'edition_id', 'DESC')} AS d FROM t)
  SELECT edition_id, team_id, round(t, 6) AS tempo_percentile, round(d, 6) AS defense_percentile, CASE WHEN t >= 0.75 THEN 'high-event' WHEN d >= 0.75 AND t < 0.5 THEN 'low-block proxy' ELSE 'balanced' END AS style_label FROM p""", "events2")
def w8(b):
    t = ledger.league_table(b.matches)
    return rounded(W.style_labels(t, group=["edition_id"]).select("edition_id", "team_id", "tempo_percentile", "defense_percentile", "style_label"))


@query("w9_fixture_radars", f"""WITH f AS (SELECT fixture_id, league_id, p_home, p_draw, p_away, 1.0::DOUBLE + fixture_id % 37 / 10.0 AS g, CASE WHEN fixture_id % 9 > 0 THEN (fixture_id % 50) / 50.0::DOUBLE END AS bt, (fixture_id % 100) / 100.0::DOUBLE AS st FROM forecasts),
   m AS (SELECT *, coalesce(bt, median(bt) OVER (PARTITION BY league_id)) AS b2 FROM f),
   r AS (SELECT *, round(({pct('g', 'league_id')} + {pct('b2', 'league_id')}) / 2, 12) AS score FROM m)
  SELECT fixture_id, round(CASE WHEN st >= 0.7 THEN CASE WHEN p_home < p_away THEN p_home ELSE p_away END - least(p_home, p_away) END, 6) AS upset_index,
   round(p_draw * 0.6 + (1 - abs(p_home - p_away)) * 0.25 + 0.15 / (1 + g), 6) AS draw_index, round(score, 6) AS goal_event_score, round({pct('score', 'league_id')}, 6) AS goal_fest_percentile FROM r""", "forecasts")
def w9(b):
    k = F.col("fixture_id")
    f = b.forecasts.select(
        "fixture_id", "league_id", "p_home", "p_draw", "p_away", (F.lit(1.0) + k % 37 / 10.0).alias("expected_total_goals"),
        F.when(k % 9 > 0, (k % 50) / 50.0).alias("p_btts_yes"), ((k % 100) / 100.0).alias("leader_stability"),
    )
    return rounded(W.fixture_radars(f, slate=["league_id"]).select("fixture_id", "upset_index", "draw_index", "goal_event_score", "goal_fest_percentile"))


@query("w10_league_trends", """SELECT fixture_id, """ + ", ".join(
    f"round(CASE WHEN count({e}) OVER w >= 10 THEN avg({e}) OVER w END, 6) AS rolling_{n}" for n, e in (
        ("total_goals", "(home_goals + away_goals)"), ("home_win", "coalesce(home_goals > away_goals, false)::INT"), ("draw", "coalesce(home_goals = away_goals, false)::INT"), ("home_advantage_goals", "(home_goals - away_goals)"))
) + """, count(*) OVER w AS sample_n FROM matches WINDOW w AS (PARTITION BY league_id ORDER BY kickoff_utc, fixture_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""", "matches")
def w10(b):
    return rounded(W.league_trends(b.matches).select("fixture_id", "rolling_total_goals", "rolling_home_win", "rolling_draw", "rolling_home_advantage_goals", "sample_n"))


@query("w11_rolling_match_features", """WITH m AS (SELECT e.fixture_id, e.team_id, e.venue_role, e.kickoff_utc, s.shots, s.xg FROM events2 e LEFT JOIN (SELECT fixture_id, team_id, count(*) AS shots, sum(xg) AS xg FROM team_shots GROUP BY ALL) s ON s.fixture_id = e.fixture_id AND s.team_id = e.team_id),
  r AS (SELECT *, avg(shots) OVER w AS s5, avg(xg) OVER w AS x5 FROM m WINDOW w AS (PARTITION BY team_id ORDER BY kickoff_utc, fixture_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
  SELECT fixture_id, round(max(CASE WHEN venue_role = 'home' THEN s5 END), 6) AS home_shots_l5, round(max(CASE WHEN venue_role = 'home' THEN x5 END), 6) AS home_xg_l5, round(max(CASE WHEN venue_role = 'away' THEN s5 END), 6) AS away_shots_l5, round(max(CASE WHEN venue_role = 'away' THEN x5 END), 6) AS away_xg_l5 FROM r GROUP BY 1""", "events2 team_shots")
def w11(b):
    per = b.team_shots.groupBy("fixture_id", "team_id").agg(F.count(F.lit(1)).alias("shots"), F.sum("xg").alias("xg"))
    rows = ledger.team_events(b.matches).select("fixture_id", "team_id", "venue_role", "kickoff_utc").join(per, ["fixture_id", "team_id"], "left")
    return rounded(W.rolling_match_features(rows, ["shots", "xg"]))


@query("w11_rolling_momentum_by_role", """SELECT fixture_id, round(max(CASE WHEN venue_role = 'home' THEN g END), 6) AS home_goal_diff_l5, round(max(CASE WHEN venue_role = 'away' THEN g END), 6) AS away_goal_diff_l5 FROM (
   SELECT fixture_id, venue_role, avg(goal_diff) OVER (PARTITION BY team_id, venue_role ORDER BY kickoff_utc, fixture_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS g FROM events2) GROUP BY 1""", "events2")
def w11_role(b):
    return rounded(W.rolling_match_features(ledger.team_events(b.matches), ["goal_diff"], keys=["team_id", "venue_role"]))


@query("w13_storylines", """SELECT 'Largest model upset' AS storyline, arg_max(fixture_id, (p_away, -fixture_id)) AS fixture_id, 'upset_index' AS metric, round(max(p_away), 6) AS value FROM forecasts UNION ALL
  SELECT 'Biggest model surprise', arg_max(fixture_id, (p_draw, -fixture_id)), 'surprise_score', round(max(p_draw), 6) FROM forecasts""", "forecasts")
def w13(b):
    rows = b.forecasts.select("fixture_id", F.col("p_away").alias("upset_index"), F.col("p_draw").alias("surprise_score"), F.lit("completed").alias("status"))
    return rounded(W.storylines(rows).select("storyline", "fixture_id", "metric", "value"))


@query("w14_team_match_log", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY kickoff_utc DESC, fixture_id DESC) AS rank FROM events2 WHERE result IS NOT NULL)
  SELECT team_id, rank, fixture_id, kickoff_utc, opponent_id, venue_role, goals_for || '-' || goals_against AS score, result FROM r WHERE rank <= 10""", "events2")
def w14(b):
    return W.team_match_log(ledger.team_events(b.matches))


@query("w15_top_drivers", """WITH d AS (SELECT l_orderkey AS fixture_id, l_returnflag AS outcome, 'part' || l_partkey AS feature, max(l_extendedprice) - 30000 AS c FROM lineitem GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY fixture_id, outcome ORDER BY abs(c) DESC, feature) AS rank FROM d)
  SELECT fixture_id, outcome, rank, feature, round(c, 6) AS contribution, feature || CASE WHEN c >= 0 THEN ' raises ' ELSE ' lowers ' END || 'the forecast' AS evidence FROM r WHERE rank <= 2""")
def w15(b):
    d = b.table("lineitem").groupBy(
        F.col("l_orderkey").alias("fixture_id"), F.col("l_returnflag").alias("outcome"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("feature")
    ).agg((F.max("l_extendedprice") - 30000).alias("contribution"))
    return rounded(W.top_drivers(d, 2))


@query("w16_sequence_dataset", """WITH c AS (SELECT *, row_number() OVER w AS i, list([goals_for, goals_against]) OVER (PARTITION BY team_id ORDER BY kickoff_utc, fixture_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS s FROM events2 WHERE result IS NOT NULL WINDOW w AS (PARTITION BY team_id ORDER BY kickoff_utc, fixture_id))
  SELECT team_id, fixture_id, kickoff_utc, array_to_string(flatten(s), ',') AS sequence, CASE result WHEN 'W' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS label FROM c WHERE i > 5""", "events2")
def w16(b):
    out = W.sequence_dataset(ledger.team_events(b.matches), ["goals_for", "goals_against"])
    return out.withColumn("sequence", F.array_join(F.transform("sequence", lambda x: x.cast("int").cast("string")), ","))


@query("w17_chronological_split", """WITH n AS (SELECT CAST(kickoff_utc AS DATE) AS d, row_number() OVER (ORDER BY CAST(kickoff_utc AS DATE)) - 1 AS i, count(*) OVER () AS n FROM matches), c AS (SELECT d AS cut FROM n WHERE i = n - greatest(1, ceil(n * 0.2))),
   n2 AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM n, c WHERE d < cut), c2 AS (SELECT d AS cut2 FROM n2 WHERE i = n - greatest(1, ceil(n * (0.2::DOUBLE / 0.8::DOUBLE))))
  SELECT fixture_id, CASE WHEN CAST(kickoff_utc AS DATE) >= cut THEN 'test' WHEN CAST(kickoff_utc AS DATE) >= cut2 THEN 'calibration' ELSE 'train' END AS part FROM matches, c, c2""", "matches")
def w17(b):
    m = b.matches.select("fixture_id", F.col("kickoff_utc").cast("date").alias("day"))
    return W.chronological_split(m, "day", calibration_size=0.2).select("fixture_id", "part")


@query("w18_rolling_origin_folds", """WITH d AS (SELECT DISTINCT CAST(kickoff_utc AS DATE) AS d FROM completed), p AS (SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n FROM d),
   q AS (SELECT d, i - ceil(n * 0.5)::BIGINT AS j, n - ceil(n * 0.5)::BIGINT AS m FROM p WHERE i > ceil(n * 0.5)), s AS (SELECT d, CASE WHEN j <= (m % 3) * (m // 3 + 1) THEN (j - 1) // (m // 3 + 1) ELSE (m % 3) + (j - 1 - (m % 3) * (m // 3 + 1)) // (m // 3) END AS fold FROM q),
   f AS (SELECT fold, min(d) AS a, max(d) AS z FROM s GROUP BY 1)
  SELECT fold, CASE WHEN CAST(kickoff_utc AS DATE) < a THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM completed JOIN f ON CAST(kickoff_utc AS DATE) <= z GROUP BY ALL""", "completed")
def w18(b):
    m = b.completed.withColumn("day", F.col("kickoff_utc").cast("date"))
    return W.assign_folds(m, W.rolling_origin_folds(m, "day"), "day").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("w19_pool_partition", f"""WITH {TABLE}, r AS (SELECT edition_id, team_id, row_number() OVER (PARTITION BY edition_id ORDER BY points DESC, team_id) AS rank FROM t) SELECT edition_id, team_id, rank, CASE WHEN rank <= 6 THEN 'top' ELSE 'middle' END AS pool FROM r WHERE rank <= 12""", "events2")
def w19(b):
    return pools(b)


@query("w22_power_rank", f"WITH {TABLE} SELECT edition_id, team_id, rank() OVER (PARTITION BY edition_id ORDER BY points DESC) AS power_rank FROM t", "events2")
def w22(b):
    from matchgrain.operators.ranks import with_ranks

    t = ledger.league_table(b.matches)
    out = with_ranks(t, {"power_rank": "points"}, group=["edition_id"], method="min", descending=True)
    return out.select("edition_id", "team_id", F.col("power_rank").cast("bigint").alias("power_rank"))


@query("s1_stable_order", "SELECT team_id, kickoff_utc, fixture_id, row_number() OVER (PARTITION BY team_id ORDER BY kickoff_utc, fixture_id) AS pos FROM events2", "events2")
def s1(b):
    from matchgrain.operators.ordered import prior_totals, time_bucket

    e = ledger.team_events(b.matches).select("team_id", "kickoff_utc", "fixture_id")
    return prior_totals(e, ["team_id"], ["kickoff_utc", "fixture_id"], time_bucket("kickoff_utc"), position="pos").orderBy("team_id", "kickoff_utc", "fixture_id")


@query("s3_union_perspectives", "SELECT team_id, venue_role, count(*) AS n FROM events2 GROUP BY ALL", "events2")
def s3(b):
    return ledger.team_events(b.matches).groupBy("team_id", "venue_role").agg(F.count(F.lit(1)).alias("n"))


@query("s4_dedupe_keep_last", "SELECT fixture_id, bookmaker, selection, max(observed_at) AS observed_at, round(arg_max(decimal_price, observed_at), 6) AS decimal_price FROM quotes GROUP BY ALL", "quotes")
def s4(b):
    from matchgrain.operators.joins import unique_by

    rows = b.quotes.select("fixture_id", "bookmaker", "selection", "observed_at", "decimal_price")
    return rounded(unique_by(rows, ["fixture_id", "bookmaker", "selection"], F.col("observed_at")))


@query("s5_set_difference", """SELECT fixture_id, 'missing' AS difference FROM matches WHERE fixture_id NOT IN (SELECT fixture_id FROM quotes) UNION ALL SELECT DISTINCT fixture_id + 1, 'unexpected' FROM quotes WHERE fixture_id % 100 = 0 AND fixture_id + 1 NOT IN (SELECT fixture_id FROM matches)""", "matches quotes")
def s5(b):
    shifted_ids = b.quotes.where("fixture_id % 100 = 0").select((F.col("fixture_id") + 1).alias("fixture_id"))
    observed = b.quotes.select("fixture_id").unionByName(shifted_ids)
    missing = ledgers.set_difference(b.matches, b.quotes, ["fixture_id"]).where("difference = 'missing'")
    unexpected = ledgers.set_difference(b.matches, observed, ["fixture_id"]).where("difference = 'unexpected'")
    return missing.unionByName(unexpected)


@query("s6_append_forecast_ledger", """SELECT fixture_id, issued_at, model_id, kickoff_utc, round(p_home, 6) AS p_home, CASE WHEN fixture_id % 3 > 0 THEN target END AS actual_outcome FROM forecasts""", "forecasts")
def s6(b):
    f = b.forecasts.select("fixture_id", "issued_at", "model_id", "kickoff_utc", "p_home", F.col("target").alias("actual_outcome"))
    old = f.where("fixture_id % 2 = 0").withColumn("actual_outcome", F.when(F.col("fixture_id") % 3 == 1, F.col("actual_outcome")))
    new = f.withColumn("actual_outcome", F.when(F.col("fixture_id") % 3 > 0, F.col("actual_outcome")))
    return rounded(ledgers.append_forecast_ledger(old, new))


@query("s7_pool_fixtures", f"""WITH {TABLE}, r AS (SELECT edition_id, team_id, row_number() OVER (PARTITION BY edition_id ORDER BY points DESC, team_id) AS rank FROM t), p AS (SELECT *, CASE WHEN rank <= 6 THEN 'top' ELSE 'middle' END AS pool FROM r WHERE rank <= 12)
  SELECT a.edition_id, a.pool, CASE WHEN rep = 1 THEN a.team_id ELSE b.team_id END AS home_team_id, CASE WHEN rep = 1 THEN b.team_id ELSE a.team_id END AS away_team_id, rep AS repeat FROM p a JOIN p b ON a.edition_id = b.edition_id AND a.pool = b.pool AND a.rank < b.rank CROSS JOIN (VALUES (1), (2)) v(rep)""", "events2")
def s7(b):
    return ledgers.pool_fixtures(pools(b), repeats=2)
