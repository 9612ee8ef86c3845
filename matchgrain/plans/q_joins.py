"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrain.operators import joins, ledger
from matchgrain.plans.bridge import shifted
from matchgrain.plans.registry import query, rounded

ENTITY_SQL = """rw AS (SELECT o_orderkey, 'p' || (o_custkey % 3) AS provider, CASE WHEN o_orderkey % 4 = 0 THEN c_name WHEN o_orderkey % 4 = 1 THEN lower(c_name) || ' x' ELSE upper(c_name) END AS raw_name,
    CAST(o_orderdate AS DATE) AS on_date, o_custkey, o_orderkey % 4 AS q FROM orders JOIN customer ON o_custkey = c_custkey),
  rs AS (SELECT rw.*, a.team_id AS alias_id, CASE WHEN q <> 1 AND o_custkey % 5 > 0 THEN o_custkey END AS canon_id FROM rw LEFT JOIN aliases a ON a.team_id = rw.o_custkey AND q <> 1
      AND (valid_from IS NULL OR CAST(valid_from AS DATE) <= on_date) AND (valid_to IS NULL OR on_date <= CAST(valid_to AS DATE)))"""


def entity_rows(b):
    q = F.col("o_orderkey") % 4
    name = F.when(q == 0, F.col("c_name")).when(q == 1, F.concat(F.lower("c_name"), F.lit(" x"))).otherwise(F.upper("c_name"))
    return b.table("orders").join(b.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select(
        "o_orderkey", F.concat(F.lit("P"), (F.col("o_custkey") % 3).cast("string")).alias("provider"), name.alias("raw_name"),
        F.col("o_orderdate").cast("date").alias("on_date"),
    )


def canonical(b):
    return b.table("customer").where("c_custkey % 5 > 0").select(F.col("c_name").alias("canonical_name"), F.col("c_custkey").alias("team_id"))


@query("c1_resolve_entities", "WITH " + ENTITY_SQL + " SELECT o_orderkey, raw_name, coalesce(alias_id, canon_id) AS team_id, CASE WHEN alias_id IS NOT NULL THEN 'provider_alias' WHEN canon_id IS NOT NULL THEN 'exact_canonical' ELSE 'unresolved' END AS team_id_status FROM rs", "aliases")
def c1(b):
    return joins.resolve_entities(entity_rows(b), b.aliases, canonical(b)).select("o_orderkey", "raw_name", "team_id", "team_id_status")


@query("c2_entity_coverage", "WITH " + ENTITY_SQL + " SELECT DISTINCT raw_name FROM rs WHERE coalesce(alias_id, canon_id) IS NULL", "aliases")
def c2(b):
    return joins.unresolved_names(joins.resolve_entities(entity_rows(b), b.aliases, canonical(b)))


@query("c2_new_team_fallback", "WITH " + ENTITY_SQL + """, ap AS (SELECT DISTINCT raw_name FROM rs WHERE coalesce(alias_id, canon_id) IS NULL AND o_custkey % 2 = 0)
  SELECT o_orderkey, coalesce(alias_id, canon_id, CASE WHEN ap.raw_name IS NOT NULL THEN -1 END) AS team_id,
   CASE WHEN alias_id IS NOT NULL THEN 'provider_alias' WHEN canon_id IS NOT NULL THEN 'exact_canonical' WHEN ap.raw_name IS NOT NULL THEN 'new_team_prior' ELSE 'unresolved' END AS team_id_status FROM rs LEFT JOIN ap USING (raw_name)""", "aliases")
def c2_new(b):
    resolved = joins.resolve_entities(entity_rows(b), b.aliases, canonical(b))
    number = F.regexp_extract("raw_name", r"(\d+)", 1).cast("bigint")
    approved = joins.unresolved_names(resolved).where(number % 2 == 0).withColumn("approved_team_id", F.lit(-1).cast("bigint"))
    return joins.with_new_team_fallback(resolved, approved).select("o_orderkey", "team_id", "team_id_status")


@query("c3_normalize_fixtures", """SELECT 'fx:' || substr(sha256(edition_id || '|px|' || fixture_id), 1, 20) AS fixture_id, CAST(fixture_id AS VARCHAR) AS provider_event_id,
   CAST(CAST(kickoff_utc AS DATE) AS TIMESTAMP) + INTERVAL 3 HOUR AS kickoff_utc, home_team_id, away_team_id, 'exact_canonical' AS home_team_id_status FROM matches""", "matches")
def c3(b):
    names = b.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("nm"))
    source = (
        b.matches.join(names.select(F.col("k").alias("home_team_id"), F.col("nm").alias("home_name")), "home_team_id")
        .join(names.select(F.col("k").alias("away_team_id"), F.col("nm").alias("away_name")), "away_team_id")
        .select(F.col("fixture_id").alias("event_id"), "home_name", "away_name", F.col("kickoff_utc").cast("date").alias("local_date"), F.lit(None).cast("string").alias("local_time"), "edition_id")
    )
    teams = b.table("customer").select(F.col("c_name").alias("canonical_name"), F.col("c_custkey").alias("team_id"))
    out = joins.normalize_fixtures(source, b.aliases, teams, edition=F.col("edition_id"), provider="px", zone="Asia/Tokyo")
    return out.select("fixture_id", "provider_event_id", F.col("kickoff_utc").cast("timestamp_ntz").alias("kickoff_utc"), "home_team_id", "away_team_id", "home_team_id_status")


@query("c4_enrich_match_xg", """WITH x AS (SELECT home_team_id AS h, away_team_id AS a, CAST(kickoff_utc AS DATE) AS d, max((coalesce(home_xg, -1), coalesce(away_xg, -1))) AS m FROM matches_xg WHERE home_xg IS NOT NULL GROUP BY ALL)
  SELECT fixture_id, round(m[1], 6) AS home_xg, round(m[2], 6) AS away_xg FROM matches LEFT JOIN x ON h = home_team_id AND a = away_team_id AND d = CAST(kickoff_utc AS DATE)""", "matches matches_xg")
def c4(b):
    keyed = lambda df: df.select("fixture_id", F.col("home_team_id").alias("HomeTeam"), F.col("away_team_id").alias("AwayTeam"), F.col("kickoff_utc").cast("date").alias("MatchDate"), *[c for c in ("home_xg", "away_xg") if c in df.columns])
    xg = keyed(b.matches_xg).drop("fixture_id").where("home_xg IS NOT NULL")
    return rounded(joins.enrich_match_xg(keyed(b.matches), xg).select("fixture_id", "home_xg", "away_xg"))


@query("c6_manager_at_kickoff", """WITH s AS (SELECT m.fixture_id, t.team_id = m.home_team_id AS home, max_by(manager_id, (observed_at, effective_from)) AS mgr FROM matches m JOIN tenures t
    ON t.team_id IN (m.home_team_id, m.away_team_id) AND observed_at < kickoff_utc AND effective_from <= kickoff_utc AND (effective_to IS NULL OR kickoff_utc < effective_to) GROUP BY ALL)
  SELECT m.fixture_id, h.mgr AS home_manager_id, a.mgr AS away_manager_id FROM matches m LEFT JOIN s h ON h.fixture_id = m.fixture_id AND h.home LEFT JOIN s a ON a.fixture_id = m.fixture_id AND NOT a.home""", "matches tenures")
def c6(b):
    return joins.manager_at_kickoff(b.matches, b.tenures)


ASSIGN = """asg AS (SELECT l_orderkey AS fixture_id, l_suppkey AS referee_id, kickoff_utc + to_days(CAST(2 - l_linenumber AS INT)) AS observed_at FROM lineitem JOIN matches m ON m.fixture_id = l_orderkey)"""


def assignments(b):
    return b.table("lineitem").join(b.matches.select(F.col("fixture_id").alias("l_orderkey"), "kickoff_utc"), "l_orderkey").select(
        F.col("l_orderkey").alias("fixture_id"), F.col("l_suppkey").alias("referee_id"), shifted("kickoff_utc", days=F.lit(2) - F.col("l_linenumber")).alias("observed_at")
    )


@query("c7_referee_at_kickoff", "WITH " + ASSIGN + """ SELECT m.fixture_id, m.kickoff_utc, r.referee_id, r.observed_at FROM matches m LEFT JOIN (
   SELECT fixture_id, max(observed_at) AS observed_at, arg_max(referee_id, (observed_at, referee_id)) AS referee_id FROM asg JOIN matches USING (fixture_id) WHERE observed_at < kickoff_utc GROUP BY 1) r USING (fixture_id)""", "matches")
def c7(b):
    return joins.referee_at_kickoff(b.matches, assignments(b))


@query("c8_availability_at_kickoff", """WITH av AS (SELECT l_orderkey AS fixture_id, l_partkey AS player_id, l_discount * 10 AS p, kickoff_utc + to_days(CAST(3 - l_linenumber AS INT)) AS observed_at, kickoff_utc FROM lineitem JOIN matches ON fixture_id = l_orderkey)
  SELECT fixture_id, player_id, max(observed_at) AS observed_at, round(arg_max(p, (observed_at, p)), 6) AS availability_probability FROM av WHERE observed_at < kickoff_utc GROUP BY 1, 2""", "matches")
def c8(b):
    m = b.matches.select("fixture_id", "kickoff_utc")
    rows = b.table("lineitem").join(m, F.col("fixture_id") == F.col("l_orderkey")).select(
        "fixture_id", F.col("l_partkey").alias("player_id"), F.lit(1).alias("team_id"), (F.col("l_discount") * 10).alias("availability_probability"),
        shifted("kickoff_utc", days=F.lit(3) - F.col("l_linenumber")).alias("observed_at"),
    )
    return rounded(joins.availability_at_kickoff(rows, m).select("fixture_id", "player_id", "observed_at", "availability_probability"))


@query("c9_latest_usable_snapshot", """SELECT fixture_id, arg_max(manager_id, (observed_at, effective_from)) AS manager_id, max(observed_at) AS tenure_observed_at FROM matches LEFT JOIN tenures t
   ON t.team_id = home_team_id AND observed_at < kickoff_utc AND effective_from <= kickoff_utc AND (effective_to IS NULL OR kickoff_utc < effective_to) GROUP BY fixture_id""", "matches tenures")
def c9(b):
    left = b.matches.select("fixture_id", "kickoff_utc", F.col("home_team_id").alias("team_id"))
    return joins.asof_valid(left, b.tenures, ["team_id"], take={"manager_id": "manager_id", "observed_at": "tenure_observed_at"}).select("fixture_id", "manager_id", "tenure_observed_at")


@query("c10_latest_quotes_before", """SELECT q.fixture_id, market, selection, bookmaker, max(observed_at) AS observed_at, round(arg_max(decimal_price, (observed_at, decimal_price)), 6) AS decimal_price
  FROM quotes q JOIN forecasts f USING (fixture_id) WHERE observed_at < issued_at - INTERVAL 2 DAY GROUP BY ALL""", "quotes forecasts")
def c10(b):
    issues = b.forecasts.select("fixture_id", shifted("issued_at", days=F.lit(-2)).alias("issued_at"))
    return rounded(joins.latest_quotes_before(b.quotes, issues))


@query("c10_latest_quotes_before_one_time", """SELECT fixture_id, market, selection, bookmaker, max(observed_at) AS observed_at, round(arg_max(decimal_price, (observed_at, decimal_price)), 6) AS decimal_price
  FROM quotes WHERE observed_at < TIMESTAMP '1998-06-01' GROUP BY ALL""", "quotes")
def c10_one(b):
    return rounded(joins.latest_quotes_before(b.quotes, issued_at=F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")))


RATINGS = """rt AS (SELECT team_id, kickoff_utc AS observed_at, max(1500.0::DOUBLE + goal_diff * 10 + fixture_id % 50) AS rating FROM events2 WHERE goal_diff IS NOT NULL GROUP BY ALL)"""


@query("c11_rating_as_of", "WITH " + RATINGS + """ SELECT m.fixture_id, coalesce(rt.rating, 1500.0) AS rating FROM (SELECT fixture_id, home_team_id AS team_id, kickoff_utc FROM matches) m
  ASOF LEFT JOIN rt ON rt.team_id = m.team_id AND rt.observed_at < m.kickoff_utc""", "events2")
def c11(b):
    e = ledger.team_events(b.completed)
    ratings = e.groupBy("team_id", F.col("kickoff_utc").alias("observed_at")).agg(F.max(F.lit(1500.0) + F.col("goal_diff") * 10 + F.col("fixture_id") % 50).alias("rating"))
    targets = b.matches.select("fixture_id", F.col("home_team_id").alias("team_id"), "kickoff_utc")
    return joins.rating_as_of(targets, ratings).select("fixture_id", "rating")


def pre_ratings(b):
    e = ledger.team_events(b.matches).where("fixture_id % 9 > 0")
    return e.select("fixture_id", "team_id", (F.lit(1400.0) + F.col("team_id") % 200).alias("pre_match_rating"), shifted("kickoff_utc", days=F.lit(-1)).alias("observed_at"))


@query("c12_fixture_difficulty", """WITH d AS (SELECT fixture_id, team_id, CASE WHEN fixture_id % 9 > 0 THEN 1400.0::DOUBLE + opponent_id % 200 ELSE 1500 END AS opponent_rating, venue_role FROM events2),
  x AS (SELECT *, opponent_rating + CASE venue_role WHEN 'home' THEN -55 ELSE 55 END AS difficulty_rating FROM d)
  SELECT fixture_id, team_id, opponent_rating, difficulty_rating, round((rank() OVER (PARTITION BY team_id ORDER BY difficulty_rating) + (count(*) OVER (PARTITION BY team_id, difficulty_rating) - 1) / 2.0) / count(*) OVER (PARTITION BY team_id), 6) AS difficulty_percentile FROM x""", "events2")
def c12(b):
    return rounded(joins.fixture_difficulty(ledger.team_events(b.matches), pre_ratings(b)).select("fixture_id", "team_id", "opponent_rating", "difficulty_rating", "difficulty_percentile"))


@query("c13_opponent_adjusted_points", "SELECT fixture_id, team_id, round(points - 3 / (1 + pow(10, -((CASE WHEN fixture_id % 9 > 0 THEN 1400.0::DOUBLE + opponent_id % 200 ELSE 1500 END) - 1500) / 400)), 6) AS opponent_adjusted_points FROM events2", "events2")
def c13(b):
    return rounded(joins.opponent_adjusted_points(ledger.team_events(b.matches), pre_ratings(b)).select("fixture_id", "team_id", "opponent_adjusted_points"))


@query("c14_upcoming_feature_matrix", """WITH h AS (SELECT home_team_id AS team_id, kickoff_utc AS t, fixture_id, 0 AS r, home_xg AS v FROM matches_xg WHERE home_xg IS NOT NULL UNION ALL SELECT away_team_id, kickoff_utc, fixture_id, 1, away_xg FROM matches_xg WHERE away_xg IS NOT NULL),
  u AS (SELECT fixture_id, kickoff_utc, home_team_id, away_team_id FROM matches WHERE status = 'scheduled'),
  s AS (SELECT u.fixture_id, arg_max(CASE WHEN h.team_id = u.home_team_id THEN v END, CASE WHEN h.team_id = u.home_team_id THEN (t, r, h.fixture_id) END) AS hx,
      arg_max(CASE WHEN h.team_id = u.away_team_id THEN v END, CASE WHEN h.team_id = u.away_team_id THEN (t, r, h.fixture_id) END) AS ax
    FROM u JOIN h ON h.team_id IN (u.home_team_id, u.away_team_id) AND h.t < u.kickoff_utc GROUP BY 1)
  SELECT u.fixture_id, round(coalesce(hx, 1.25), 6) AS home_form, round(coalesce(ax, 1.5), 6) AS away_form, CASE WHEN u.fixture_id % 3 = 0 THEN 9.0::DOUBLE ELSE 0.5 END AS given, 2.5::DOUBLE AS absent
  FROM u LEFT JOIN s USING (fixture_id)""", "matches_xg")
def c14(b):
    upcoming = b.matches.where("status = 'scheduled'").withColumn("given", F.when(F.col("fixture_id") % 3 == 0, 9.0))
    cols = {"home_history_column": "home_xg", "away_history_column": "away_xg"}
    sources = {"home_form": {"fixture_role": "home", **cols}, "away_form": {"fixture_role": "away", **cols}}
    means = {"home_form": 1.25, "away_form": 1.5, "given": 0.5, "absent": 2.5}
    return rounded(joins.upcoming_feature_matrix(b.matches_xg, upcoming, list(means), means=means, state_sources=sources))


@query("c15_action_features_at_kickoff", """WITH s AS (SELECT fixture_id, team_id, sum(action_value) AS v, count(DISTINCT action_id) AS n, max(observed_at) AS o FROM actions GROUP BY ALL),
  t AS (SELECT fixture_id, kickoff_utc, team_id, venue_role AS side FROM events2)
  SELECT t.fixture_id, t.team_id, t.side, round(sum(pow(2, -(epoch(t.kickoff_utc) - epoch(o)) / 86400.0 / 90) * v) / sum(pow(2, -(epoch(t.kickoff_utc) - epoch(o)) / 86400.0 / 90) * n), 6) AS lagged_action_value_per_action,
    coalesce(sum(n), 0)::BIGINT AS history_actions, max(o) AS feature_timestamp
  FROM t LEFT JOIN s ON s.team_id = t.team_id AND o < t.kickoff_utc AND s.fixture_id <> t.fixture_id GROUP BY ALL""", "actions events2")
def c15(b):
    from matchgrain.operators.aggregates import action_summary

    return rounded(joins.action_features_at_kickoff(action_summary(b.actions, b.matches), b.matches))


@query("c16_manager_by_date", """WITH r AS (SELECT c_custkey AS team_id, DATE '1995-06-01' + CAST(i * 400 AS INT) AS s, DATE '1995-06-01' + CAST(i * 400 + 420 AS INT) AS e, c_custkey * 10 + i AS manager, i FROM customer CROSS JOIN range(4) t(i)),
  d AS (SELECT fixture_id, home_team_id, CAST(kickoff_utc AS DATE) AS day FROM matches)
  SELECT d.fixture_id, coalesce(min_by(r.manager, r.i), max(CASE WHEN home_team_id % 4 > 0 THEN -home_team_id END)) AS manager FROM d LEFT JOIN r ON r.team_id = d.home_team_id AND d.day BETWEEN r.s AND r.e GROUP BY d.fixture_id""", "matches")
def c16(b):
    i = F.col("ordinal")
    day = lambda n: F.date_add(F.lit("1995-06-01").cast("date"), n.cast("int"))
    ranges = b.table("customer").select(F.col("c_custkey").alias("team_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ordinal")).select(
        "team_id", day(i * 400).alias("start_date"), day(i * 400 + 420).alias("end_date"), (F.col("team_id") * 10 + i).alias("manager"), "ordinal"
    )
    current = b.table("customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("team_id"), (-F.col("c_custkey")).alias("manager"))
    rows = b.matches.select("fixture_id", F.col("home_team_id").alias("team_id"), F.col("kickoff_utc").cast("date").alias("match_date"))
    return joins.manager_by_date(rows, ranges, current).select("fixture_id", "manager")


@query("c17_weather_enrichment", """WITH rd AS (SELECT home_team_id || '_' || strftime(kickoff_utc, '%Y-%m-%d') AS k, arg_max((fixture_id % 7)::DOUBLE, fixture_id) AS rain, arg_max('code ' || (fixture_id % 5), fixture_id) AS txt FROM matches WHERE fixture_id % 3 = 0 GROUP BY 1)
  SELECT fixture_id, coalesce(rain, 0) AS "Precipitation", coalesce(txt, 'Unknown') AS "WeatherDescription" FROM matches LEFT JOIN rd ON k = home_team_id || '_' || strftime(kickoff_utc, '%Y-%m-%d')""", "matches")
def c17(b):
    m = b.matches.withColumn("match_date", F.col("kickoff_utc").cast("date"))
    readings = m.where("fixture_id % 3 = 0").select(
        F.concat_ws("_", F.col("home_team_id").cast("string"), F.date_format("match_date", "yyyy-MM-dd")).alias("cache_key"),
        (F.col("fixture_id") % 7).cast("double").alias("Precipitation"), F.concat(F.lit("code "), (F.col("fixture_id") % 5).cast("string")).alias("WeatherDescription"), F.col("fixture_id").alias("fetched_at"),
    )
    return joins.weather_enrichment(m, readings).select("fixture_id", "Precipitation", "WeatherDescription")


@query("c18_injury_features", """WITH n AS (SELECT user_id AS team_id, count(*) AS c FROM events WHERE event_type = 'error' GROUP BY 1)
  SELECT fixture_id, coalesce(h.c, 0) AS "HomeInjuryCount", coalesce(a.c, 0) AS "AwayInjuryCount", coalesce(a.c, 0) - coalesce(h.c, 0) AS "InjuryAdvantage" FROM matches LEFT JOIN n h ON h.team_id = home_team_id LEFT JOIN n a ON a.team_id = away_team_id""", "matches")
def c18(b):
    injuries = b.table("events").where("event_type = 'error'").select(F.col("user_id").alias("team_id"))
    return joins.injury_features(b.matches, injuries).select("fixture_id", "HomeInjuryCount", "AwayInjuryCount", "InjuryAdvantage")


@query("c19_referee_assignment_join", """WITH a AS (SELECT home_team_id, away_team_id, CAST(kickoff_utc AS DATE) AS d, max('R' || (fixture_id % 40)) AS r FROM matches WHERE fixture_id % 2 = 0 GROUP BY ALL)
  SELECT fixture_id, coalesce(r, 'Not yet assigned') AS "Referee" FROM matches m LEFT JOIN a ON a.home_team_id = m.home_team_id AND a.away_team_id = m.away_team_id AND a.d = CAST(kickoff_utc AS DATE)""", "matches")
def c19(b):
    m = b.matches.select("fixture_id", "home_team_id", "away_team_id", F.col("kickoff_utc").cast("date").alias("match_date"))
    a = m.where("fixture_id % 2 = 0").select("home_team_id", "away_team_id", "match_date", F.concat(F.lit("R"), (F.col("fixture_id") % 40).cast("string")).alias("Referee"))
    return joins.referee_assignment_join(m, a).select("fixture_id", "Referee")


@query("c20_settle_predictions", """WITH r AS (SELECT home_team_id, away_team_id, CAST(kickoff_utc AS DATE) AS d, min(CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END) AS res FROM completed GROUP BY ALL),
  f AS (SELECT f.*, m.home_team_id, m.away_team_id, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END AS pick FROM forecasts f JOIN matches m USING (fixture_id))
  SELECT fixture_id, res AS actual_result, pick = res AS correct FROM f LEFT JOIN r ON r.home_team_id = f.home_team_id AND r.away_team_id = f.away_team_id AND r.d = CAST(f.kickoff_utc AS DATE)""", "forecasts completed")
def c20(b):
    gap = F.col("home_goals") - F.col("away_goals")
    keyed = b.matches.withColumn("match_date", F.col("kickoff_utc").cast("date"))
    results = keyed.where("home_goals IS NOT NULL").withColumn("result", F.when(gap > 0, "H").when(gap == 0, "D").otherwise("A"))
    log = b.forecasts.select("fixture_id", "p_home", "p_draw", "p_away", F.lit(None).cast("string").alias("actual_result"), F.lit(None).cast("boolean").alias("correct")).join(
        keyed.select("fixture_id", "match_date", "home_team_id", "away_team_id"), "fixture_id"
    )
    return joins.settle_predictions(log, results).select("fixture_id", "actual_result", "correct")


@query("c21_best_bets", """WITH o AS (SELECT fixture_id, max(CASE WHEN selection = 'home' THEN decimal_price END) AS oh, max(CASE WHEN selection = 'draw' THEN decimal_price END) AS od, max(CASE WHEN selection = 'away' THEN decimal_price END) AS oa FROM quotes GROUP BY 1),
  j AS (SELECT f.fixture_id, CASE WHEN f.fixture_id % 5 = 0 THEN 0.3::DOUBLE ELSE p_home END AS h, p_draw AS d, p_away AS a, oh, od, oa FROM forecasts f JOIN o USING (fixture_id) WHERE oh > 1 AND od > 1 AND oa > 1),
  x AS (SELECT fixture_id, unnest(['Home Win', 'Draw', 'Away Win']) AS pick, unnest([h, d, a]) / (h + d + a) AS p, unnest([oh, od, oa]) AS o, 1 / oh + 1 / od + 1 / oa AS s FROM j)
  SELECT fixture_id, pick, round(p::VARCHAR::DECIMAL(38,18), 4)::DOUBLE AS confidence, round((p - 1 / o / s)::VARCHAR::DECIMAL(38,18), 4)::DOUBLE AS edge, round((1 / o / s)::VARCHAR::DECIMAL(38,18), 4)::DOUBLE AS market_probability, round((p * o - 1)::VARCHAR::DECIMAL(38,18), 4)::DOUBLE AS expected_value,
   CASE WHEN p * o - 1 >= 0.12 THEN 'Elite' WHEN p * o - 1 >= 0.07 THEN 'Strong' ELSE 'Good' END AS tier, round_even(CASE WHEN o >= 2 THEN (o - 1) * 100 ELSE -100 / (o - 1) END, 0)::BIGINT AS odds
  FROM x WHERE p - 1 / o / s >= 0.03 AND p * o - 1 >= 0.03""", "quotes forecasts")
def c21(b):
    price = lambda s: F.max(F.when(F.col("selection") == s, F.col("decimal_price")))
    odds = b.quotes.groupBy("fixture_id").agg(price("home").alias("B365H"), price("draw").alias("B365D"), price("away").alias("B365A"))
    p = b.forecasts.select(
        "fixture_id", F.when(F.col("fixture_id") % 5 > 0, F.col("p_home")).otherwise(0.0).alias("HomeWin_Prob"), F.col("p_draw").alias("Draw_Prob"),
        F.col("p_away").alias("AwayWin_Prob"), F.lit(0.3).alias("PredHomeWin"),
    )
    return joins.best_bets(p, odds)


@query("c22_eligible_opponents", """WITH t0 AS (SELECT edition_id, team_id, sum(points) AS s FROM events2 WHERE goals_for IS NOT NULL GROUP BY edition_id, team_id), t AS (SELECT edition_id, team_id, row_number() OVER (PARTITION BY edition_id ORDER BY s DESC, team_id) AS r FROM t0),
  p AS (SELECT edition_id, team_id, CASE WHEN r <= 6 THEN 'top' ELSE 'middle' END AS pool FROM t WHERE r <= 12)
  SELECT a.edition_id, a.pool, a.team_id, b.team_id AS opponent_id FROM p a JOIN p b ON a.edition_id = b.edition_id AND a.pool = b.pool AND a.team_id <> b.team_id""", "events2")
def c22(b):
    return joins.eligible_opponents(pools(b)).select("edition_id", "pool", "team_id", "opponent_id")


def pools(b):
    from matchgrain.operators.windows import pool_partition

    table = ledger.league_table(b.matches, tie_breakers=("points",))
    return pool_partition(table, [("top", 6), ("middle", 6)]).select("edition_id", "pool", "team_id", "rank")


@query("c23_coverage_match", """SELECT count(*) FILTER (WHERE b.fixture_id IS NULL) AS only_champion, count(*) FILTER (WHERE a.fixture_id IS NULL) AS only_challenger,
   count(*) FILTER (WHERE a.fixture_id IS NOT NULL AND b.fixture_id IS NOT NULL AND a.target <> b.target) AS target_mismatch, count(*) FILTER (WHERE a.fixture_id IS NOT NULL AND b.fixture_id IS NOT NULL) AS shared
  FROM (SELECT fixture_id, target FROM scored WHERE fixture_id % 10 > 0) a FULL JOIN (SELECT fixture_id, CASE WHEN fixture_id % 50 = 7 THEN 2 - target ELSE target END AS target FROM scored WHERE fixture_id % 7 > 0) b USING (fixture_id)""", "scored")
def c23(b):
    challenger = b.scored.where("fixture_id % 7 > 0").withColumn("target", F.when(F.col("fixture_id") % 50 == 7, 2 - F.col("target")).otherwise(F.col("target")))
    return joins.coverage_match(b.scored.where("fixture_id % 10 > 0"), challenger)


@query("c24_context_timeline", """SELECT fixture_id, observed_at, referee_id, NULL::DOUBLE AS action_value, 'referee' AS context_source FROM asg UNION ALL SELECT fixture_id, observed_at, NULL, round(action_value, 6), 'action' FROM actions""".join(["WITH " + ASSIGN + " ", ""]), "matches actions")
def c24(b):
    return rounded(joins.context_timeline(referee=assignments(b), action=b.actions.select("fixture_id", "observed_at", "action_value")))


@query("c25_squad_size_features", """WITH n AS (SELECT user_id AS team_id, count(DISTINCT event_id % 40) AS c FROM events GROUP BY 1)
  SELECT fixture_id, coalesce(h.c, 0) AS "HomeSquadSize", coalesce(a.c, 0) AS "AwaySquadSize", coalesce(h.c, 0) - coalesce(a.c, 0) AS "SquadSizeAdvantage" FROM matches LEFT JOIN n h ON h.team_id = home_team_id LEFT JOIN n a ON a.team_id = away_team_id""", "matches")
def c25(b):
    players = b.table("events").select(F.col("user_id").alias("team_id"), (F.col("event_id") % 40).alias("player_id"))
    return joins.squad_size_features(b.matches, players).select("fixture_id", "HomeSquadSize", "AwaySquadSize", "SquadSizeAdvantage")


@query("c26_match_poisson_lookup", """WITH st AS (SELECT team_id, avg(CASE WHEN venue_role = 'home' THEN goals_for END) + 0.2 AS ha, avg(CASE WHEN venue_role = 'home' THEN goals_against END) + 0.2 AS hd, avg(CASE WHEN venue_role = 'away' THEN goals_for END) + 0.2 AS aa, avg(CASE WHEN venue_role = 'away' THEN goals_against END) + 0.2 AS ad
      FROM events2 WHERE goals_for IS NOT NULL AND team_id % 6 > 0 GROUP BY 1),
    r AS (SELECT fixture_id, h.team_id IS NOT NULL AND a.team_id IS NOT NULL AS known, coalesce(h.ha, 1.5) * coalesce(a.ad, 1.1) / 1.4::DOUBLE AS lh, coalesce(a.aa, 1.3) * coalesce(h.hd, 1.2) / 1.4::DOUBLE AS la
      FROM matches m LEFT JOIN st h ON h.team_id = m.home_team_id LEFT JOIN st a ON a.team_id = m.away_team_id),
    g AS (SELECT fixture_id, i, j, exp(i * ln(lh) - lh - lgamma(i + 1)) * exp(j * ln(la) - la - lgamma(j + 1)) AS p FROM r CROSS JOIN range(6) x(i) CROSS JOIN range(6) y(j) WHERE known),
    o AS (SELECT fixture_id, sum(CASE WHEN i > j THEN p ELSE 0 END) / sum(p) AS h, sum(CASE WHEN i = j THEN p ELSE 0 END) / sum(p) AS d, sum(CASE WHEN i < j THEN p ELSE 0 END) / sum(p) AS a FROM g GROUP BY 1)
    SELECT r.fixture_id, round(coalesce(h, 0.33), 6) AS "HomeWinProb", round(coalesce(d, 0.34), 6) AS "DrawProb", round(coalesce(a, 0.33), 6) AS "AwayWinProb", CASE WHEN NOT known THEN 'Team statistics not found' END AS error,
      round(CASE WHEN known THEN 1 - exp(-lh) - exp(-la) + exp(-lh - la) END, 6) AS "BTTSYesProb" FROM r LEFT JOIN o USING (fixture_id)""", "events2")
def c26(b):
    e = ledger.team_events(b.completed).where("team_id % 6 > 0")
    mean = lambda role, c: F.avg(F.when(F.col("venue_role") == role, F.col(c))) + 0.2
    stats = e.groupBy("team_id").agg(
        F.coalesce(mean("home", "goals_for"), F.lit(1.5)).alias("HomeGoalsAve"), F.coalesce(mean("home", "goals_against"), F.lit(1.2)).alias("HomeGoalsConcededAve"),
        F.coalesce(mean("away", "goals_for"), F.lit(1.3)).alias("AwayGoalsAve"), F.coalesce(mean("away", "goals_against"), F.lit(1.1)).alias("AwayGoalsConcededAve"),
    )
    return rounded(joins.match_poisson_lookup(b.matches, stats).select("fixture_id", "HomeWinProb", "DrawProb", "AwayWinProb", "error", "BTTSYesProb"))
