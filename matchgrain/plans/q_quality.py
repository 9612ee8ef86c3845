"""Quality and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrain.operators import grids, quality
from matchgrain.operators import projections as P
from matchgrain.plans.registry import query, rounded


@query("a17_table_profile", """SELECT count(*) AS rows, min(kickoff_utc) AS min_event_time, max(kickoff_utc) AS max_event_time, round(avg((home_goals IS NOT NULL)::INT), 6) AS coverage, max(kickoff_utc) + INTERVAL 7 DAY AS fresh_until FROM matches""", "matches")
def a17(b):
    return rounded(quality.table_profile(b.matches, time="kickoff_utc", coverage_of="home_goals").drop("content_hash"))


@query("d20_data_quality_summary", """WITH m AS (SELECT CASE WHEN fixture_id % 50 = 0 THEN NULL ELSE CAST(kickoff_utc AS DATE) END AS d, home_team_id, away_team_id, home_goals, away_goals FROM matches)
  SELECT count(*) AS rows, count(*) FILTER (WHERE d IS NULL) AS invalid_dates, count(*) FILTER (WHERE d > DATE '2001-01-01') AS future_rows, min(d) AS earliest, max(d) AS latest,
   (SELECT coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM m GROUP BY d, home_team_id, away_team_id HAVING count(*) > 1)) AS duplicate_fixtures,
   (SELECT coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM m GROUP BY home_goals, away_goals HAVING count(*) > 1)) AS duplicate_feature_rows FROM m""", "matches")
def d20(b):
    rows = b.matches.select(F.when(F.col("fixture_id") % 50 != 0, F.col("kickoff_utc").cast("date")).alias("MatchDate"), "home_team_id", "away_team_id", "home_goals", "away_goals")
    return quality.data_quality_summary(rows, F.lit("2001-01-01").cast("date"), key=("home_team_id", "away_team_id"), features=["home_goals", "away_goals"])


def canonical(b):
    k = F.col("fixture_id")
    return b.matches.select(
        F.when(k % 1000 == 5, F.lit(-1)).otherwise(k).alias("fixture_id"), "edition_id", F.when(k % 700 != 0, "1").otherwise("").alias("rules_version"), "kickoff_utc",
        F.when(k % 300 != 0, F.col("home_team_id")).alias("home_team_id"), "away_team_id", k.alias("provider_event_id"), F.lit("s").alias("source"),
        F.when(k % 400 != 0, F.col("kickoff_utc")).alias("observed_at"),
    )


@query("d21_fixture_quality_gates", """WITH c AS (SELECT count(*) FILTER (WHERE fixture_id % 1000 = 5) - 1 AS a, count(*) FILTER (WHERE fixture_id % 300 = 0) AS u, count(*) FILTER (WHERE fixture_id % 400 = 0) AS t, count(*) FILTER (WHERE fixture_id % 700 = 0) AS r FROM matches),
  l AS (SELECT unnest(['duplicate_fixture_ids', 'duplicate_provider_events', 'unresolved_active_teams', 'invalid_timestamps', 'self_fixtures', 'missing_edition_or_rules']) AS "check", unnest([a, 0, u, t, 0, r]) AS observed FROM c)
  SELECT "check", CASE WHEN observed = 0 THEN 'passed' ELSE 'failed' END AS status, 'blocking' AS severity, observed, 0::BIGINT AS expected FROM l""", "matches")
def d21(b):
    return quality.fixture_quality_gates(canonical(b))


@query("d22_point_in_time_gates", """WITH c AS (SELECT count(*) FILTER (WHERE fixture_id % 90 = 0) AS l, count(*) FILTER (WHERE home_goals IS NULL) AS n FROM matches), x AS (SELECT unnest(['feature_fixture_coverage', 'observed_at_before_kickoff', 'finite_model_inputs']) AS "check", unnest([0, l, n]) AS observed FROM c)
  SELECT "check", CASE WHEN observed = 0 THEN 'passed' ELSE 'failed' END AS status, 'blocking' AS severity, observed, 0::BIGINT AS expected FROM x""", "matches")
def d22(b):
    from matchgrain.plans.bridge import shifted

    features = b.matches.select("fixture_id", F.col("home_goals").cast("double").alias("x"), shifted("kickoff_utc", minutes=F.when(F.col("fixture_id") % 90 == 0, 0).otherwise(-1)).alias("observed_at"))
    return quality.point_in_time_gates(features, b.matches)


@query("d22_forecast_metadata_gates", """WITH c AS (SELECT count(*) FILTER (WHERE fixture_id % 31 = 0) AS s FROM forecasts), x AS (SELECT unnest(['forecast_issued_before_kickoff', 'forecast_effective_sample', 'forecast_cold_start_status']) AS "check", unnest([0, s, 0]) AS observed FROM c)
  SELECT "check", CASE WHEN observed = 0 THEN 'passed' ELSE 'failed' END AS status, 'blocking' AS severity, observed, 0::BIGINT AS expected FROM x""", "forecasts")
def d22_meta(b):
    f = b.forecasts.withColumn("effective_sample_size", F.when(F.col("fixture_id") % 31 == 0, -1.0).otherwise(5.0)).withColumn("cold_start_status", F.lit("full"))
    return quality.forecast_metadata_gates(f, b.matches)


def coherent(b):
    r = b.rates.where("home_goals IS NULL")
    grid = grids.fixed_poisson_grid(r, max_goals=20).withColumnRenamed("p", "probability")
    f = grids.one_x_two(grid.withColumnRenamed("probability", "p"))
    off = F.when(F.col("fixture_id") % 40 == 0, 0.01).otherwise(0.0)
    return b.matches, f.withColumns({"p_home": F.col("p_home") + off, "p_away": F.col("p_away") - off}), grid


@query("d23_forecast_coherence", """WITH c AS (SELECT count(*) FILTER (WHERE fixture_id % 40 = 0) AS n FROM matches WHERE status = 'scheduled'), x AS (SELECT unnest(['forecast_ids', 'valid_probabilities', 'probabilities_sum_to_one', 'scoreline_mass', 'scoreline_agreement']) AS "check", unnest([0, 0, 0, 0, n]) AS observed FROM c)
  SELECT "check", CASE WHEN observed = 0 THEN 'passed' ELSE 'failed' END AS status, 'blocking' AS severity, observed, 0::BIGINT AS expected FROM x""", "matches")
def d23(b):
    return quality.forecast_coherence(*coherent(b))


@query("d29_publication_gate", """SELECT 8 AS checks, false AS publishable, 'duplicate_fixture_ids, invalid_timestamps, missing_edition_or_rules, unresolved_active_teams' AS failures FROM matches LIMIT 1""", "matches")
def d29(b):
    return quality.publication_gate(quality.fixture_quality_gates(canonical(b)), quality.match_value_gates(b.matches, b.quotes))


@query("d30_feature_availability", """SELECT 'f' || p_partkey AS feature, CASE WHEN p_size % 3 = 0 THEN 'deferred' WHEN p_size % 5 = 0 THEN 'capability_unavailable' ELSE 'shipped' END AS status, CASE WHEN p_size % 3 = 0 THEN 'missing: zz' WHEN p_size % 5 = 0 THEN 'down' END AS reason FROM part""")
def d30(b):
    s = F.col("p_size")
    features = b.table("part").select(
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feature"), F.when(s % 3 == 0, F.array(F.lit("REGION"), F.lit("zz"))).otherwise(F.array(F.upper(F.lit("region")))).alias("required"),
        F.when(s % 5 == 0, "c0").when(s % 5 == 1, "c1").alias("capability"),
    )
    names = b.table("region").select(F.lit("REGION").alias("table_name")).distinct()
    caps = b.table("region").select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("capability"), F.when(F.col("r_regionkey") == 0, "failed").otherwise("available").alias("status"), F.lit("down").alias("reason"))
    return quality.feature_availability(features, names, caps)


def hash_table(b):
    """Tables per draw without random numbers, so that SQL can follow."""
    return b.stored("standings-plain", lambda: _plain(b))


def _plain(b):
    from matchgrain.operators.ledger import league_table

    goals = F.coalesce("home_goals", (F.col("fixture_id") * 7 + F.col("draw_id") * 3) % 5), F.coalesce("away_goals", (F.col("fixture_id") * 5 + F.col("draw_id")) % 4)
    table = league_table(b.matches, keys=["edition_id", "draw_id"], draws=("draw_id", F.sequence(F.lit(0), F.lit(9))), goals=goals)
    return table.select("edition_id", "draw_id", "team_id", "points", "position")


PLAIN = """g AS (SELECT edition_id, d AS draw_id, home_team_id, away_team_id, coalesce(home_goals, (fixture_id * 7 + d * 3) % 5) AS h, coalesce(away_goals, (fixture_id * 5 + d) % 4) AS a FROM matches CROSS JOIN range(10) t(d)),
  e AS (SELECT edition_id, draw_id, home_team_id AS team_id, h AS f, a AS g FROM g UNION ALL SELECT edition_id, draw_id, away_team_id, a, h FROM g),
  t AS (SELECT edition_id, draw_id, team_id, sum(CASE WHEN f > g THEN 3 WHEN f = g THEN 1 ELSE 0 END) AS points, sum(f - g) AS gd, sum(f) AS gf FROM e GROUP BY ALL),
  s AS (SELECT *, row_number() OVER (PARTITION BY edition_id, draw_id ORDER BY points DESC, gd DESC, gf DESC, team_id) AS position FROM t)"""


@query("p3_position_probabilities", f"WITH {PLAIN}, m AS (SELECT edition_id, team_id, avg(points) AS mp FROM s GROUP BY ALL) SELECT edition_id, team_id, position, round(count(*) / 10.0, 6)::DOUBLE AS probability, round(any_value(mp), 6) AS mean_points FROM s JOIN m USING (edition_id, team_id) GROUP BY ALL", "matches")
def p3(b):
    return rounded(P.position_probabilities(hash_table(b), 10))


def labels(b):
    return b.table("region").where("r_regionkey < 2").select(
        F.when(F.col("r_regionkey") == 0, "title").otherwise("top_four").alias("label"), F.lit(1).cast("bigint").alias("first_position"),
        F.when(F.col("r_regionkey") == 0, 1).otherwise(4).cast("bigint").alias("last_position"),
    )


@query("p3_outcome_probabilities", f"WITH {PLAIN} SELECT edition_id, team_id, label, round(count(*) / 10.0, 6)::DOUBLE AS probability FROM s JOIN (VALUES ('title', 1), ('top_four', 4)) l(label, z) ON position <= z GROUP BY ALL", "matches")
def p3_labels(b):
    return rounded(P.outcome_probabilities(P.position_probabilities(hash_table(b), 10), labels(b)))


@query("p4_validate_positions", "SELECT DISTINCT edition_id, 0::BIGINT AS bad_team_id, 0::BIGINT AS bad_position FROM matches", "matches")
def p4(b):
    return P.validate_positions(P.position_probabilities(hash_table(b), 10))


@query("p5_points_target", f"WITH {PLAIN}, l AS (SELECT edition_id, draw_id, min(points) AS p FROM s WHERE position <= 4 GROUP BY ALL) SELECT edition_id, round(quantile_cont(p, 0.1), 6) AS p10, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.9), 6) AS p90 FROM l GROUP BY 1", "matches")
def p5(b):
    return rounded(P.points_target(hash_table(b), 4))
