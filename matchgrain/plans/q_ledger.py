"""Queries over the team-event ledger and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrain.operators import ledger
from matchgrain.operators.ordered import prior_ewm, time_bucket
from matchgrain.plans.registry import query, rounded

TABLE_SQL = """
SELECT edition_id, team_id, count(*) AS played, count(*) FILTER (WHERE result = 'W') AS wins,
       count(*) FILTER (WHERE result = 'D') AS draws, count(*) FILTER (WHERE result = 'L') AS losses,
       sum(goals_for)::BIGINT AS goals_for, sum(goals_against)::BIGINT AS goals_against,
       sum(goals_for - goals_against)::BIGINT AS goal_difference, sum(points)::BIGINT AS points
FROM events2 WHERE goals_for IS NOT NULL GROUP BY edition_id, team_id"""


@query(
    "d1_league_table",
    f"""WITH t AS ({TABLE_SQL})
    SELECT *, row_number() OVER (PARTITION BY edition_id
      ORDER BY points DESC, goal_difference DESC, goals_for DESC, team_id) AS position FROM t""",
    "events2",
)
def d1(b):
    return ledger.league_table(b.matches)


@query(
    "d1_league_table_with_sanctions",
    f"""WITH t AS ({TABLE_SQL}), a AS (
      SELECT edition_id, team_id, points - CASE WHEN team_id % 10 = 0 THEN 3 ELSE 0 END AS points,
             played, wins, draws, losses, goals_for, goals_against, goal_difference FROM t)
    SELECT *, row_number() OVER (PARTITION BY edition_id
      ORDER BY points DESC, goal_difference DESC, goals_for DESC, team_id) AS position FROM a""",
    "events2",
)
def d1_sanctions(b):
    teams = b.matches.select(
        "edition_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")
    ).distinct()
    adjustments = teams.where("team_id % 10 = 0").withColumn("points_adjustment", F.lit(-3))
    return ledger.league_table(b.matches, adjustments=adjustments)


@query(
    "d2_head_to_head_points",
    f"""WITH t AS ({TABLE_SQL}), lv AS (
      SELECT e.edition_id, e.team_id, sum(e.points)::BIGINT AS h
      FROM events2 e JOIN t a ON a.edition_id = e.edition_id AND a.team_id = e.team_id
      JOIN t b ON b.edition_id = e.edition_id AND b.team_id = e.opponent_id AND a.points = b.points
      WHERE e.goals_for IS NOT NULL GROUP BY ALL)
    SELECT t.*, coalesce(h, 0) AS head_to_head_points, row_number() OVER (PARTITION BY t.edition_id
      ORDER BY t.points DESC, coalesce(h, 0) DESC, goal_difference DESC, t.team_id) AS position
    FROM t LEFT JOIN lv ON lv.edition_id = t.edition_id AND lv.team_id = t.team_id""",
    "events2",
)
def d2(b):
    return ledger.league_table(
        b.matches, tie_breakers=("points", "head_to_head_points", "goal_difference")
    )


@query(
    "w1_team_events",
    """SELECT fixture_id, league_id, edition_id, kickoff_utc, team_id, opponent_id, venue_role,
         goals_for::DOUBLE AS goals_for, goals_against::DOUBLE AS goals_against, goal_diff::DOUBLE AS goal_diff,
         points, result FROM events2""",
    "events2",
)
def w1(b):
    return ledger.team_events(b.matches)


@query(
    "w2_prior_rolling",
    """SELECT fixture_id, team_id,
         sum(points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS points_prior5_sum,
         round(avg(goals_for) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 6) AS goals_prior8_mean
       FROM events2 WINDOW w AS (PARTITION BY team_id ORDER BY kickoff_utc, fixture_id)""",
    "events2",
)
def w2(b):
    events = ledger.team_events(b.matches)
    out = ledger.prior_rolling(events, "team_id", "points", 5, "points_prior5_sum", aggregation="sum")
    out = ledger.prior_rolling(out, "team_id", "goals_for", 8, "goals_prior8_mean")
    return rounded(out.select("fixture_id", "team_id", "points_prior5_sum", "goals_prior8_mean"))


STATE_SQL = """
SELECT fixture_id, team_id, venue_role, kickoff_utc,
  count(goals_for) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history_n,
  round((epoch(kickoff_utc) - epoch(lag(kickoff_utc) OVER w)) / 86400.0, 6) AS rest_days,
  sum(points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS points_l5,
  round(avg(goals_for) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS goals_for_l5,
  round(avg(goals_against) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS goals_against_l5,
  round(avg(goal_diff) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS goal_diff_l10,
  round(avg((goals_against = 0)::INT) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS clean_sheet_l10
FROM events2 WINDOW w AS (PARTITION BY team_id ORDER BY kickoff_utc, fixture_id)"""
STATE_COLUMNS = [
    "history_n", "rest_days", "points_l5", "goals_for_l5", "goals_against_l5", "goal_diff_l10", "clean_sheet_l10",
]


@query(
    "w3_prior_team_state",
    f"SELECT * EXCLUDE (venue_role, kickoff_utc) FROM ({STATE_SQL})",
    "events2",
)
def w3(b):
    state = ledger.prior_team_state(ledger.team_events(b.matches))
    return rounded(state.select("fixture_id", "team_id", *STATE_COLUMNS))


@query(
    "w4_prior_ewm",
    """WITH e AS (
      SELECT fixture_id, team_id, goals_for::DOUBLE AS x,
             row_number() OVER (PARTITION BY team_id ORDER BY kickoff_utc, fixture_id) AS i
      FROM events2 WHERE goals_for IS NOT NULL)
    SELECT a.fixture_id, a.team_id,
      round(sum(CASE WHEN p.i = 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / 11 END * pow(9.0::DOUBLE / 11, a.i - 1 - p.i) * p.x), 6) AS goals_for_ewm10
    FROM e a LEFT JOIN e p ON p.team_id = a.team_id AND p.i < a.i GROUP BY ALL""",
    "events2",
)
def w4(b):
    events = ledger.team_events(b.completed)
    out = prior_ewm(
        events, ["team_id"], ["kickoff_utc", "fixture_id"], time_bucket("kickoff_utc"), {"goals_for": "goals_for_ewm10"}
    )
    return rounded(out.select("fixture_id", "team_id", "goals_for_ewm10"))


@query("w4_weighted_team_state")
def w4_state(b):
    state = ledger.prior_team_state(ledger.team_events(b.matches_xg))
    names = [f"{s}_ewm10" for s in ledger.weighted_sources(state)]
    return rounded(state.select("fixture_id", "team_id", *names))


@query(
    "c5_match_feature_snapshots",
    "WITH s AS (" + STATE_SQL + ") SELECT h.fixture_id, "
    + ", ".join(f"{r[0]}.{c} AS {r}_{c}" for r in ("home", "away") for c in STATE_COLUMNS)
    + " FROM s h JOIN s a ON a.fixture_id = h.fixture_id AND a.venue_role = 'away' WHERE h.venue_role = 'home'",
    "events2",
)
def c5(b):
    return rounded(ledger.match_feature_snapshots(ledger.prior_team_state(ledger.team_events(b.matches))))


@query(
    "w5_recovery_load",
    """WITH x AS (
      SELECT e.fixture_id, team_id, kickoff_utc,
        ((team_id * 7) % 120 - 60)::DOUBLE AS venue_lat, ((team_id * 13) % 300 - 150)::DOUBLE AS venue_lon,
        ((opponent_id * 7) % 120 - 60)::DOUBLE AS previous_venue_lat, ((opponent_id * 13) % 300 - 150)::DOUBLE AS previous_venue_lon,
        CASE WHEN fixture_id % 3 = 0 THEN 'Low' ELSE 'High' END AS venue_confidence FROM events2 e),
    y AS (SELECT *, (epoch(kickoff_utc) - epoch(lag(kickoff_utc) OVER w)) / 86400.0 AS d,
        row_number() OVER w - 1 AS upto,
        (SELECT count(*) FROM x o WHERE o.team_id = x.team_id AND o.kickoff_utc < x.kickoff_utc - INTERVAL 14 DAY) AS older,
        CASE WHEN venue_confidence = 'High' THEN 2 * 6371.0088::DOUBLE * asin(sqrt(
          pow(sin(radians(venue_lat - previous_venue_lat) / 2), 2)
          + cos(radians(previous_venue_lat)) * cos(radians(venue_lat)) * pow(sin(radians(venue_lon - previous_venue_lon) / 2), 2))) END AS km
      FROM x WINDOW w AS (PARTITION BY team_id ORDER BY kickoff_utc, fixture_id))
    SELECT fixture_id, team_id, round(d, 6) AS days_since_previous, upto - older AS matches_previous_14d,
      coalesce(d < 4, false) AS short_rest, round(km, 4) AS travel_km,
      round(coalesce(d < 4, false)::INT + (upto - older) / 5.0 + least(coalesce(km, 0) / 2000, 1), 6) AS recovery_load,
      CASE WHEN km IS NOT NULL THEN 'venue_verified' ELSE 'omitted_low_or_missing_confidence' END AS travel_confidence
    FROM y""",
    "events2",
)
def w5(b):
    place = lambda c, k, m, s: ((F.col(c) * k) % m - s).cast("double")
    fixtures = ledger.team_events(b.matches).select(
        "fixture_id", "team_id", "kickoff_utc",
        place("team_id", 7, 120, 60).alias("venue_lat"), place("team_id", 13, 300, 150).alias("venue_lon"),
        place("opponent_id", 7, 120, 60).alias("previous_venue_lat"),
        place("opponent_id", 13, 300, 150).alias("previous_venue_lon"),
        F.when(F.col("fixture_id") % 3 == 0, "Low").otherwise("High").alias("venue_confidence"),
    )
    out = ledger.recovery_features(fixtures).withColumn("travel_km", F.round("travel_km", 4))
    return rounded(
        out.select(
            "fixture_id", "team_id", "days_since_previous", "matches_previous_14d", "short_rest", "travel_km",
            "recovery_load", "travel_confidence",
        )
    )


WALK_FORWARD = """g AS (SELECT *, (home_goals IS NOT NULL)::INT AS done, coalesce(home_goals, 0) AS h, coalesce(away_goals, 0) AS a FROM matches),
    s AS (SELECT *, 
      coalesce(sum(h + a) OVER (PARTITION BY league_id ORDER BY kickoff_utc, fixture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lg,
      coalesce(sum(done) OVER (PARTITION BY league_id ORDER BY kickoff_utc, fixture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ln,
      coalesce(sum(h) OVER wh, 0) AS hf, coalesce(sum(a) OVER wh, 0) AS ha, coalesce(sum(done) OVER wh, 0) AS hn,
      coalesce(sum(a) OVER wa, 0) AS af, coalesce(sum(h) OVER wa, 0) AS aa, coalesce(sum(done) OVER wa, 0) AS an
      FROM g WINDOW wh AS (PARTITION BY league_id, home_team_id ORDER BY kickoff_utc, fixture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        wa AS (PARTITION BY league_id, away_team_id ORDER BY kickoff_utc, fixture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT *, (lg + 56.0::DOUBLE) / (2 * (ln + 20.0::DOUBLE)) AS lr FROM s),
    wf AS (SELECT fixture_id, lr, (hf + lr * 5) / (hn + 5.0::DOUBLE) * (aa + lr * 5) / (an + 5.0::DOUBLE) / lr AS home_rate,
      (af + lr * 5) / (an + 5.0::DOUBLE) * (ha + lr * 5) / (hn + 5.0::DOUBLE) / lr AS away_rate FROM r)"""


@query(
    "w12_walk_forward_rates",
    f"WITH {WALK_FORWARD} SELECT fixture_id, round(lr, 6) AS league_rate, round(home_rate, 6) AS home_rate, round(away_rate, 6) AS away_rate FROM wf",
    "matches",
)
def w12_rates(b):
    return rounded(ledger.walk_forward_rates(b.matches).select("fixture_id", "league_rate", "home_rate", "away_rate"))
