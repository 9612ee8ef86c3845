"""Aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrain.operators import aggregates as A
from matchgrain.operators import ledger, markets
from matchgrain.operators.ordered import dealt
from matchgrain.plans.registry import query, rounded


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


PART_QUOTES = 500_000


def fair(b):
    """Fair quotes, dealt out once by the market that all steps of a query group by, in parts that are sorted in memory."""
    return markets.devig_multiplicative(dealt(b.quotes, "fixture_id", "market", rows=PART_QUOTES))


@query("d3_consensus_market", """SELECT fixture_id, market, selection, round(median(fair_probability), 6) AS consensus_probability, round(min(fair_probability), 6) AS market_low, round(max(fair_probability), 6) AS market_high,
  count(DISTINCT bookmaker) AS books, round(max(decimal_price), 6) AS best_price, max(observed_at) AS observed_at FROM fair GROUP BY ALL""", "fair")
def d3(b):
    return rounded(A.consensus_market(fair(b)))


@query("d4_consensus_probability", """WITH m AS (SELECT fixture_id, market, selection, sum((1 + bookmaker) * fair_probability) / sum(1 + bookmaker) AS p FROM fair GROUP BY ALL)
  SELECT fixture_id, market, selection, round(p / sum(p) OVER (PARTITION BY fixture_id, market), 6) AS consensus_probability FROM m""", "fair")
def d4(b):
    return rounded(A.consensus_probability(fair(b), (F.lit(1.0) + F.col("bookmaker"))))


@query("d5_market_movement", """WITH e AS (SELECT *, min(observed_at) OVER w AS o, max(observed_at) OVER w AS c FROM fair WINDOW w AS (PARTITION BY fixture_id, market, selection))
  SELECT fixture_id, market, selection, round(median(CASE WHEN observed_at = o THEN fair_probability END), 6) AS opening_probability, round(median(CASE WHEN observed_at = c THEN fair_probability END), 6) AS current_probability,
   round(median(CASE WHEN observed_at = c THEN fair_probability END) - median(CASE WHEN observed_at = o THEN fair_probability END), 6) AS probability_move, min(o) AS opening_observed_at, max(c) AS current_observed_at,
   round(max(CASE WHEN observed_at = c THEN decimal_price END), 6) AS current_best_price, round(max(CASE WHEN observed_at = c THEN fair_probability END) - min(CASE WHEN observed_at = c THEN fair_probability END), 6) AS current_dispersion,
   count(DISTINCT CASE WHEN observed_at = c THEN bookmaker END) AS current_books FROM e GROUP BY ALL""", "fair")
def d5(b):
    return rounded(A.market_movement(fair(b)))


@query("d6_referee_profile", """WITH a AS (SELECT l_suppkey AS referee_id, l_orderkey, l_quantity % 7 AS cards, (l_linenumber = 1)::INT AS pens, l_quantity AS fouls FROM lineitem),
  l AS (SELECT sum(cards) / count(*) AS c, sum(pens) / count(*) AS p FROM a)
  SELECT referee_id, count(DISTINCT l_orderkey) AS matches, round(sum(cards), 6) AS cards, sum(pens)::BIGINT AS penalties, round(sum(fouls), 6) AS fouls,
   round((sum(cards) + any_value(l.c) * 20) / (count(DISTINCT l_orderkey) + 20), 6) AS cards_per_match_shrunk, round((sum(pens) + any_value(l.p) * 20) / (count(DISTINCT l_orderkey) + 20), 6) AS penalty_rate_shrunk FROM a, l GROUP BY referee_id""")
def d6(b):
    rows = b.table("lineitem").select(
        F.col("l_suppkey").alias("referee_id"), F.col("l_orderkey").alias("fixture_id"), (F.col("l_quantity") % 7).alias("cards"),
        (F.col("l_linenumber") == 1).cast("bigint").alias("penalties"), F.col("l_quantity").alias("fouls"),
    )
    league = rows.select("cards", "penalties", F.lit(1).alias("matches"))
    return rounded(A.referee_profile(rows, league))


@query("d7_squad_absence_impact", """SELECT l_suppkey AS team_id, round(sum((1 - least(1, l_discount * 10)) * CASE WHEN p_size IS NULL THEN 0 ELSE p_size / 50.0::DOUBLE END * (coalesce(p_size / 50.0::DOUBLE - 0.5, -0.25) + 0.25)), 6) AS expected_missing_strength,
  count(*) FILTER (WHERE 1 - least(1, l_discount * 10) > 0.25) AS players_flagged FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size % 3 > 0 GROUP BY 1""")
def d7(b):
    availability = b.table("lineitem").select(F.col("l_partkey").alias("player_id"), F.col("l_suppkey").alias("team_id"), (F.col("l_discount") * 10).alias("availability_probability"))
    strength = b.table("part").where("p_size % 3 > 0").select(F.col("p_partkey").alias("player_id"), (F.col("p_size") / 50.0).alias("minutes_share"), (F.col("p_size") / 50.0 - 0.5).alias("strength_per90"))
    return rounded(A.squad_absence_impact(availability, strength))


@query("d8_lineup_strength", """WITH m AS (SELECT l_orderkey AS fixture_id, l_suppkey % 2 AS team_id, least(90, l_quantity * 3) AS em, p_size, p_size * 40.0::DOUBLE AS mins FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size % 4 > 0)
  SELECT fixture_id, team_id, round(sum(CASE WHEN p_size IS NULL THEN 0 ELSE em / 90 * (mins / (mins + 900) * p_size / 100 + 900 / (mins + 900) * 0.02) END) + greatest(0, 990 - sum(CASE WHEN p_size IS NULL THEN 0 ELSE em END)) / 90 * 0.02, 6) AS lineup_attack,
   round(sum(CASE WHEN p_size IS NULL THEN 0 ELSE em / 90 * (mins / (mins + 900) * p_size / 200 + 900 / (mins + 900) * 0.01) END) + greatest(0, 990 - sum(CASE WHEN p_size IS NULL THEN 0 ELSE em END)) / 90 * 0.01, 6) AS lineup_defense,
   round(least(1, sum(CASE WHEN p_size IS NULL THEN 0 ELSE em END) / 990), 6) AS coverage FROM m GROUP BY ALL""")
def d8(b):
    members = b.table("lineitem").select(F.col("l_orderkey").alias("fixture_id"), (F.col("l_suppkey") % 2).alias("team_id"), F.col("l_partkey").alias("player_id"), F.least(F.lit(90.0), F.col("l_quantity") * 3).alias("expected_minutes"))
    s = F.col("p_size")
    strengths = b.table("part").where("p_size % 4 > 0").select(F.col("p_partkey").alias("player_id"), (s / 100.0).alias("attack_per90"), (s / 200.0).alias("defense_per90"), (s * 40.0).alias("minutes"))
    return rounded(A.lineup_strength(members, strengths, replacement_attack=0.02, replacement_defense=0.01))


@query("d9_action_summary", "SELECT fixture_id, team_id, round(sum(action_value), 6) AS action_value, count(DISTINCT action_id) AS actions, max(observed_at) AS observed_at FROM actions GROUP BY ALL", "actions")
def d9(b):
    return rounded(A.action_summary(b.actions, b.matches))


@query("d10_team_snapshot", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY kickoff_utc DESC, fixture_id DESC) AS rn, count(*) OVER (PARTITION BY team_id) AS n FROM events2 WHERE goals_for IS NOT NULL AND kickoff_utc < TIMESTAMP '1999-06-01'),
  g AS (SELECT avg(goals_for) AS lm FROM e)
  SELECT team_id, count(*) AS matches, sum(points) AS points, sum(points) FILTER (WHERE rn <= 5) AS points_l5, round(avg(points) FILTER (WHERE rn <= 10), 6) AS points_per_match_l10, round(avg(goals_for) FILTER (WHERE rn <= 10), 6) AS attack_l10,
   round(avg(goals_against) FILTER (WHERE rn <= 10), 6) AS defense_l10, round(avg(goal_diff) FILTER (WHERE rn <= 10), 6) AS goal_difference_l10, round(avg((goals_against = 0)::INT) FILTER (WHERE rn <= 10), 6) AS clean_sheet_rate_l10,
   round((coalesce(sum(goals_for) FILTER (WHERE venue_role = 'home'), 0) + any_value(lm) * 5) / (count(*) FILTER (WHERE venue_role = 'home') + 5), 6) AS home_goals_for_shrunk,
   round((coalesce(sum(goals_for) FILTER (WHERE venue_role = 'away'), 0) + any_value(lm) * 5) / (count(*) FILTER (WHERE venue_role = 'away') + 5), 6) AS away_goals_for_shrunk,
   count(*) FILTER (WHERE venue_role = 'home') AS home_sample, count(*) FILTER (WHERE venue_role = 'away') AS away_sample, 1400.0::DOUBLE + team_id % 97 AS elo_rating, max(kickoff_utc) AS latest_kickoff,
   rank() OVER (ORDER BY team_id % 97 DESC) AS power_rank,
   round(sum(CASE WHEN rn <= 10 THEN points * exp(CASE WHEN n > 1 THEN -2.0 * (rn - 1) / (least(n, 10) - 1) ELSE -2 END) END) / sum(CASE WHEN rn <= 10 THEN exp(CASE WHEN n > 1 THEN -2.0 * (rn - 1) / (least(n, 10) - 1) ELSE -2 END) END), 6) AS opponent_adjusted_points_l10
  FROM e, g GROUP BY team_id""", "events2")
def d10(b):
    ratings = b.table("customer").select(F.col("c_custkey").alias("team_id"), (F.lit(1400.0) + F.col("c_custkey") % 97).alias("rating"))
    events = ledger.team_events(b.matches).withColumn("opponent_adjusted_points", F.col("points"))
    out = A.team_snapshot(events, as_of=ts("1999-06-01"), ratings=ratings)
    return rounded(out.withColumn("power_rank", F.col("power_rank").cast("bigint")))


@query("d11_cross_league_export", "SELECT league_id, edition_id, count(*) AS fixtures, round(avg(home_goals + away_goals), 6) AS goals_per_match, round(avg(home_goals - away_goals), 6) AS home_advantage_goals, round(avg((home_goals = away_goals)::INT), 6) AS draw_rate FROM completed GROUP BY ALL", "completed")
def d11(b):
    return rounded(A.cross_league_export(b.completed))


@query("d12_competitive_balance", """WITH t AS (SELECT edition_id, team_id, 1500.0::DOUBLE + sum(goal_diff) AS r, 1.0::DOUBLE + sum(points) AS p FROM events2 WHERE goals_for IS NOT NULL GROUP BY ALL)
  SELECT edition_id, round(stddev_pop(r) / greatest(abs(avg(r)), 1e-9), 6) AS normalized_strength_dispersion, round(sum(p * p) / (sum(p) * sum(p)), 6) AS title_herfindahl, round((1 - sum(p * p) / (sum(p) * sum(p))) / greatest(1 - 1 / count(*)::DOUBLE, 1e-9), 6) AS parity_index FROM t GROUP BY 1""", "events2")
def d12(b):
    t = ledger.team_events(b.completed).groupBy("edition_id", "team_id").agg((F.lit(1500.0) + F.sum("goal_diff")).alias("rating"), (F.lit(1.0) + F.sum("points")).alias("title_probability"))
    return rounded(A.competitive_balance(t, ["edition_id"]))


DIAG = """count(*) AS matches, round(avg(home_goals), 6) AS home_mean, round(avg(away_goals), 6) AS away_mean, round(var_samp(home_goals), 6) AS home_variance, round(var_samp(away_goals), 6) AS away_variance,
   round(CASE WHEN avg(home_goals) <> 0 THEN var_samp(home_goals) / avg(home_goals) END, 6) AS home_dispersion, round(CASE WHEN avg(away_goals) <> 0 THEN var_samp(away_goals) / avg(away_goals) END, 6) AS away_dispersion, round(avg((home_goals = 0 AND away_goals = 0)::INT), 6) AS zero_zero_rate,
   round(avg((home_goals = away_goals)::INT), 6) AS draw_rate, round(avg((home_goals + away_goals <= 1)::INT), 6) AS low_score_rate, round(avg((home_goals + away_goals >= 4)::INT), 6) AS four_plus_rate FROM completed"""


@query("d13_goal_diagnostics", f"SELECT league_id, {DIAG} GROUP BY league_id", "completed")
def d13(b):
    return rounded(A.goal_diagnostics(b.matches, ["league_id"]))


@query("d13_goal_diagnostics_overall", f"SELECT {DIAG}", "completed")
def d13_all(b):
    return rounded(A.goal_diagnostics(b.matches))


@query("d14_shot_team_match", """SELECT fixture_id, team_id, count(*) AS shots, round(sum(xg), 6) AS xg_sum, round(avg(xg), 6) AS xg_mean, round(avg(xgot), 6) AS xgot_mean, count(*) FILTER (WHERE round(xg, 9) > 0.3) AS big_chances,
  round(CASE WHEN sum(xg) <> 0 THEN sum(CASE WHEN situation = 'A' THEN xg ELSE 0 END) * 100 / sum(xg) ELSE 0 END, 6) AS set_piece_xg_share FROM team_shots GROUP BY ALL""", "team_shots")
def d14(b):
    shots = b.team_shots.withColumn("set_piece", F.col("situation") == "A").withColumn("xg", F.round("xg", 9))
    return rounded(A.shot_team_match(shots))


@query("d15_player_team_match", """SELECT l_orderkey AS fixture_id, l_suppkey % 2 AS team_id, sum(l_quantity) AS passes, sum(floor(l_quantity * 0.75)) AS passes_ok, sum(l_linenumber % 3)::BIGINT AS duels_won, sum(l_linenumber % 2)::BIGINT AS duels_lost,
   round(sum(floor(l_quantity * 0.75)) * 100 / sum(l_quantity), 6) AS pass_pct, round(CASE WHEN sum(l_linenumber % 3) + sum(l_linenumber % 2) > 0 THEN sum(l_linenumber % 3) * 100.0 / (sum(l_linenumber % 3) + sum(l_linenumber % 2)) ELSE 50 END, 6) AS duel_pct, 50.0::DOUBLE AS aerial_pct FROM lineitem GROUP BY ALL""")
def d15(b):
    q, ln = F.col("l_quantity"), F.col("l_linenumber")
    players = b.table("lineitem").select(
        F.col("l_orderkey").alias("fixture_id"), (F.col("l_suppkey") % 2).alias("team_id"), q.alias("passes"), F.floor(q * 0.75).cast("double").alias("passes_ok"),
        (ln % 3).alias("duels_won"), (ln % 2).alias("duels_lost"), F.lit(0).alias("aerials_won"), F.lit(0).alias("aerials_lost"),
    )
    return rounded(A.player_team_match(players).drop("aerials_won", "aerials_lost"))


@query("d16_momentum_features", """WITH e AS (SELECT user_id AS fixture_id, event_id, minute(ts) * 1.5 AS minute, value - 100 AS v FROM events),
  s AS (SELECT *, lag(sign(v)) OVER (PARTITION BY fixture_id ORDER BY minute, event_id) AS p FROM e)
  SELECT fixture_id, round(avg(v), 6) AS momentum_mean, round(stddev_pop(v), 6) AS momentum_std, round(avg(CASE WHEN minute >= 75 THEN v END), 6) AS momentum_late, round(avg(CASE WHEN minute <= 45 THEN v END), 6) AS momentum_first_half,
   count(*) FILTER (WHERE sign(v) <> p) AS momentum_shifts FROM s GROUP BY 1""")
def d16(b):
    points = b.table("events").select(F.col("user_id").alias("fixture_id"), "event_id", (F.minute("ts") * 1.5).alias("minute"), (F.col("value") - 100).alias("value"))
    return rounded(A.momentum_features(points))


@query("d17_league_statistics", """SELECT league_id, count(*) AS matches, count(*) FILTER (WHERE home_goals > away_goals) AS home_wins, count(*) FILTER (WHERE home_goals = away_goals) AS draws, count(*) FILTER (WHERE home_goals < away_goals) AS away_wins,
   round(avg((home_goals > away_goals)::INT), 6) AS home_wins_share, round(avg((home_goals = away_goals)::INT), 6) AS draws_share, round(avg((home_goals < away_goals)::INT), 6) AS away_wins_share, round(avg(home_goals + away_goals), 6) AS goals_per_match FROM completed GROUP BY 1""", "completed")
def d17(b):
    return rounded(A.league_statistics(b.matches))


@query("s2_top_k", "SELECT team_id, sum(goals_for)::BIGINT AS goals FROM events2 WHERE goals_for IS NOT NULL GROUP BY 1 ORDER BY goals DESC, team_id LIMIT 10", "events2")
def s2(b):
    return A.top_scoring_teams(b.matches)


@query("d18_confidence_histogram", """WITH f AS (SELECT greatest(p_home, p_draw, p_away) AS m FROM scored), e AS (SELECT * FROM (VALUES (1, 0.0, 0.4), (2, 0.4, 0.45), (3, 0.45, 0.5), (4, 0.5, 0.55), (5, 0.55, 0.6), (6, 0.6, 0.7), (7, 0.7, 1.0)) v(bucket, low, high))
  SELECT bucket, low::DOUBLE AS low, high::DOUBLE AS high, count(m) AS n, round(avg(m), 6) AS mean_confidence FROM e LEFT JOIN f ON m <= high::DOUBLE AND (m > low::DOUBLE OR bucket = 1) GROUP BY ALL""", "scored")
def d18(b):
    return rounded(A.confidence_histogram(b.scored))


@query("d19_feature_inventory", """SELECT 'fixture_id' AS "column", 'football' AS category, 'bigint' AS dtype, 0.0::DOUBLE AS missing_rate, count(DISTINCT fixture_id) AS distinct_values FROM matches
  UNION ALL SELECT 'home_goals', 'football', 'bigint', round(avg((home_goals IS NULL)::INT), 6), count(DISTINCT home_goals) FROM matches UNION ALL SELECT 'odds_home', 'market', 'bigint', 0, count(DISTINCT away_team_id) FROM matches""", "matches")
def d19(b):
    return rounded(A.feature_inventory(b.matches.select("fixture_id", "home_goals", F.col("away_team_id").alias("odds_home"))))


@query("d24_manager_effect", """SELECT t.manager_id, round((coalesce(sum(points - 1.35), 0) + 0.1 * 12) / (count(points) + 12), 6) AS manager_effect FROM events2 e JOIN tenures t ON t.team_id = e.team_id AND kickoff_utc >= effective_from AND (effective_to IS NULL OR kickoff_utc < effective_to) GROUP BY 1""", "events2 tenures")
def d24(b):
    from matchgrain.operators.joins import asof_valid

    events = ledger.team_events(b.matches).select("fixture_id", "team_id", "kickoff_utc", (F.col("points") - 1.35).alias("residual_points"))
    named = asof_valid(events, b.tenures, ["team_id"], ids=["fixture_id", "team_id"], take={"manager_id": "manager_id"}).where("manager_id IS NOT NULL")
    return rounded(A.manager_effect(named, prior_mean=0.1))


@query("d25_head_to_head", """WITH w AS (SELECT team_id, opponent_id, points, exp(-ln(2) * (epoch(TIMESTAMP '2000-01-01') - epoch(kickoff_utc)) / 86400 / 365) AS w FROM events2 WHERE points IS NOT NULL AND kickoff_utc < TIMESTAMP '2000-01-01')
  SELECT team_id, opponent_id, count(*) AS matches, round(sum(w), 6) AS effective_matches, CASE WHEN sum(w) >= 3 THEN 'high' WHEN sum(w) >= 1 THEN 'low_relevance' ELSE 'insufficient' END AS quality, round(sum(w * points) / sum(w), 6) AS weighted_points_per_match FROM w GROUP BY ALL""", "events2")
def d25(b):
    return rounded(A.head_to_head(ledger.team_events(b.matches), ts("2000-01-01")))


@query("d26_importance_by_category", """SELECT 'Red' AS category, round(sum(p_retailprice) FILTER (WHERE p_name ILIKE '%red%'), 4) AS importance FROM part UNION ALL SELECT 'Ring', round(sum(p_retailprice) FILTER (WHERE p_name ILIKE '%ring%'), 4) FROM part
  UNION ALL SELECT 'Other', round(sum(p_retailprice) - sum(p_retailprice) FILTER (WHERE p_name ILIKE '%red%') - sum(p_retailprice) FILTER (WHERE p_name ILIKE '%ring%'), 4) FROM part""")
def d26(b):
    rows = b.table("part").select(F.col("p_name").alias("feature"), F.col("p_retailprice").alias("importance"))
    return rounded(A.importance_by_category(rows, {"Red": "(?i)red", "Ring": "(?i)ring"}), 4)


@query("d27_injury_counts", "SELECT user_id AS team_id, count(*) AS injuries FROM events WHERE event_type = 'error' GROUP BY 1")
def d27(b):
    return A.injury_counts(b.table("events").where("event_type = 'error'").select(F.col("user_id").alias("team_id")))


@query("d27_imputation_means", """WITH t AS (SELECT avg(home_goals) AS h, avg(away_goals) AS a FROM matches WHERE kickoff_utc < TIMESTAMP '1999-01-01')
  SELECT fixture_id, round(coalesce(home_goals, (SELECT h FROM t)), 6)::DOUBLE AS home_goals, round(coalesce(away_goals, (SELECT a FROM t)), 6)::DOUBLE AS away_goals FROM matches""", "matches")
def d27_means(b):
    m = b.matches.select("fixture_id", "kickoff_utc", F.col("home_goals").cast("double").alias("home_goals"), F.col("away_goals").cast("double").alias("away_goals"))
    return rounded(A.impute(m, m.where(F.col("kickoff_utc") < ts("1999-01-01")), ["home_goals", "away_goals"]).drop("kickoff_utc"))


@query("d28_team_form", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY kickoff_utc DESC, fixture_id DESC) AS rn FROM events2 WHERE result IS NOT NULL)
  SELECT team_id, string_agg(result, '' ORDER BY rn) AS form, count(*) FILTER (WHERE result = 'W') AS wins, count(*) FILTER (WHERE result = 'D') AS draws, count(*) FILTER (WHERE result = 'L') AS losses, sum(points) AS points FROM r WHERE rn <= 5 GROUP BY 1""", "events2")
def d28(b):
    return A.team_form(ledger.team_events(b.matches))


@query("d31_event_type_profile", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 20")
def d31(b):
    return A.event_type_profile(b.table("events"), "event_type")
