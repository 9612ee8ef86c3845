"""Row-level expressions over the bridge views."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrain.functions import scalars as S
from matchgrain.plans.registry import query, rounded


@query(
    "b1_parse_match_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END AS match_date FROM orders""",
)
def b1(b):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.concat(F.lit(" "), F.date_format(d, "dd/MM/yyyy")))
        .when(k == 2, F.date_format(d, "d/M/yyyy"))
        .otherwise(F.lit("n/a"))
    )
    return b.table("orders").select("o_orderkey", S.parse_match_dates(text).alias("match_date"))


@query("b2_completed_match_rows", "SELECT fixture_id, CAST(kickoff_utc AS DATE) AS MatchDate, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END AS FullTimeResult FROM completed", "completed")
def b2(b):
    return S.completed_match_rows(legacy(b))


def legacy(b):
    """Matches under the long legacy column names."""
    gap = F.col("home_goals") - F.col("away_goals")
    return b.matches.select(
        "fixture_id",
        F.date_format("kickoff_utc", "yyyy-MM-dd").alias("MatchDate"),
        F.when(gap > 0, "H").when(gap == 0, "D").when(gap < 0, "A").alias("FullTimeResult"),
    )


@query("b3_completed_future_rows", "SELECT fixture_id, CAST(kickoff_utc AS DATE) AS MatchDate FROM completed WHERE CAST(kickoff_utc AS DATE) > DATE '1998-01-02'", "completed")
def b3(b):
    rows = legacy(b).withColumn("MatchDate", S.parse_match_dates("MatchDate"))
    return S.completed_future_rows(rows, F.lit("1998-01-01").cast("date")).select("fixture_id", "MatchDate")


def policy_frame(b):
    """A history table with legacy names, for the column policies."""
    return b.matches_xg.select(
        "fixture_id", F.col("home_goals").alias("FullTimeHomeGoals"), F.col("home_shots").alias("HomeShots"),
        F.col("home_xg").alias("HomeXGPrior"), F.col("away_xg").alias("AwayXGPrior"),
        (F.lit(1.0) + F.col("fixture_id") % 5).alias("B365H"), F.lit(2.5).alias("MarketMargin"),
        F.lit(0.1).alias("RefCards"), F.lit(1).alias("API_StandingsRank"), F.lit(0.0).alias("HomeZScore"),
        F.lit(1.9).alias("ClosingHome"), F.lit(1.8).alias("AvgCA"),
    )


@query("b4_select_prematch_columns", """SELECT fixture_id, round(home_xg, 6) AS HomeXGPrior, round(away_xg, 6) AS AwayXGPrior, 1.0::DOUBLE + fixture_id % 5 AS "B365H", 2.5::DOUBLE AS MarketMargin, 1.8::DOUBLE AS "AvgCA" FROM matches_xg""", "matches_xg")
def b4(b):
    return rounded(S.select_prematch_columns(policy_frame(b)))


@query("b5_select_no_market_columns", "SELECT fixture_id, round(home_xg, 6) AS HomeXGPrior, round(away_xg, 6) AS AwayXGPrior FROM matches_xg", "matches_xg")
def b5(b):
    return rounded(S.assert_independent_track(S.select_no_market_columns(policy_frame(b))))


@query("b6_kickoff_utc", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y FROM orders),
  e AS (SELECT *, last_day(make_date(y, 3, 1)) AS spring, last_day(make_date(y, CASE WHEN y < 1996 THEN 9 ELSE 10 END, 1)) AS autumn FROM o)
  SELECT o_orderkey, (d + CASE WHEN o_orderkey % 5 = 0 THEN INTERVAL 12 HOUR ELSE to_minutes(CAST(720 + o_orderkey % 600 AS INT)) END)
   - CASE WHEN d >= spring - CAST(dayofweek(spring) AS INT) AND d < autumn - CAST(dayofweek(autumn) AS INT) THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS kickoff_utc FROM e""")
def b6(b):
    """Summer time in Brussels: last Sunday of March to that of September, from 1996 on of October; no clock here is before noon."""
    day = F.col("o_orderdate").cast("date")
    minute = (F.lit(720) + F.col("o_orderkey") % 600).cast("int")
    clock = F.when(F.col("o_orderkey") % 5 != 0, F.format_string("%02d:%02d", F.floor(minute / 60), minute % 60))
    return b.table("orders").select("o_orderkey", S.kickoff_utc(day, clock, "Europe/Brussels").cast("timestamp_ntz").alias("kickoff_utc"))


@query("b7_season_id", "SELECT fixture_id, (year(kickoff_utc) - (month(kickoff_utc) < 7)::INT) || '-' || lpad((((year(kickoff_utc) - (month(kickoff_utc) < 7)::INT) + 1) % 100)::VARCHAR, 2, '0') AS season FROM matches", "matches")
def b7(b):
    return b.matches.select("fixture_id", S.season_id("kickoff_utc").alias("season"))


@query("b8_local_kickoff", "SELECT fixture_id, kickoff_utc + INTERVAL 9 HOUR AS kickoff_local FROM matches", "matches")
def b8(b):
    return b.matches.select("fixture_id", S.local_kickoff("kickoff_utc", "Asia/Tokyo").cast("timestamp_ntz").alias("kickoff_local"))


@query("b9_normalize_name", r"""SELECT c_custkey, trim(regexp_replace(replace(lower(strip_accents(c_name || ' É&Ô ' || c_nationkey)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS name_key,
  trim(regexp_replace(replace(lower(strip_accents(c_name || ' É&Ô ' || c_nationkey)), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS name_slug FROM customer""")
def b9(b):
    raw = F.concat(F.col("c_name"), F.lit(" É&Ô "), F.col("c_nationkey").cast("string"))
    return b.table("customer").select("c_custkey", S.normalize_name(raw).alias("name_key"), S.slug(raw).alias("name_slug"))


@query("b10_stable_fixture_id", "SELECT fixture_id, 'fx:' || substr(sha256(edition_id || '|bridge|' || fixture_id), 1, 20) AS stable_id FROM matches", "matches")
def b10(b):
    return b.matches.select("fixture_id", S.stable_fixture_id("edition_id", F.lit("bridge"), "fixture_id").alias("stable_id"))


@query("b11_normalize_team_name", "SELECT c.c_custkey, coalesce(n.n_name, c.c_name) AS team_name FROM customer c LEFT JOIN nation n ON c.c_custkey % 50 = n.n_nationkey AND c.c_custkey % 2 = 0")
def b11(b):
    code = F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") % 50).cast("string")).otherwise(F.col("c_name"))
    base = b.table("nation").select(F.col("n_nationkey").cast("string").alias("alias"), "n_name")
    aliases = base.select("alias", F.col("n_name").alias("team_name"), F.lit(2).alias("priority")).unionByName(
        base.select("alias", F.lit("default").alias("team_name"), F.lit(1).alias("priority"))
    )
    rows = b.table("customer").select("c_custkey", "c_name", code.alias("code"))
    named = S.normalize_team_name(rows, "code", aliases, "found")
    missing = F.col("found") == F.col("code")
    return named.select("c_custkey", F.when(missing, F.col("c_name")).otherwise(F.col("found")).alias("team_name"))


@query("b12_haversine_km", """WITH c AS (SELECT fixture_id, radians((home_team_id % 170 - 85)::DOUBLE) AS la, radians((home_team_id % 350 - 175)::DOUBLE) AS oa,
   radians((away_team_id % 170 - 85)::DOUBLE) AS lb, radians((away_team_id % 350 - 175)::DOUBLE) AS ob FROM matches)
 SELECT fixture_id, round(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((lb - la) / 2), 2) + cos(la) * cos(lb) * pow(sin((ob - oa) / 2), 2))), 4) AS km FROM c""", "matches")
def b12(b):
    at = lambda t, m: (F.col(t) % m - m // 2).cast("double")
    km = S.haversine_km(at("home_team_id", 170), at("home_team_id", 350), at("away_team_id", 170), at("away_team_id", 350))
    return b.matches.select("fixture_id", F.round(km, 4).alias("km"))


WEATHER = """w AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id % 8)::DOUBLE END AS rain,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 23)::DOUBLE END AS wind,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 37 - 3)::DOUBLE END AS temp, user_id, ts FROM events)"""


def weather(b):
    e = F.col("event_id")
    return b.table("events").select(
        "event_id", "user_id", "ts",
        F.when(e % 17 != 0, (e % 8).cast("double")).alias("rain"),
        F.when(e % 13 != 0, (e % 23).cast("double")).alias("wind"),
        F.when(e % 11 != 0, (e % 37 - 3).cast("double")).alias("temp"),
    )


@query("b13_weather_category", "WITH " + WEATHER + """ SELECT event_id, CASE WHEN rain IS NULL THEN 'Unknown' WHEN rain > 5 THEN 'Heavy Rain'
  WHEN wind > 15 THEN 'Windy' WHEN temp < 5 THEN 'Cold' WHEN temp > 25 THEN 'Hot' ELSE 'Normal' END AS impact FROM w""")
def b13(b):
    return weather(b).select("event_id", S.weather_category("rain", "wind", "temp").alias("impact"))


@query("b14_weather_at_kickoff_hour", """WITH h AS (SELECT user_id AS stadium, CAST(ts AS DATE) AS day, hour(ts) AS hour, min(value) AS temp, min(event_id % 4) AS code FROM events GROUP BY ALL)
 SELECT stadium, day, arg_min(hour, abs(hour - 16) * 100 + hour)::BIGINT AS hour, round(arg_min(temp, abs(hour - 16) * 100 + hour), 6) AS temp,
   ['Clear sky', 'Mainly clear', 'Partly cloudy', 'Overcast'][arg_min(code, abs(hour - 16) * 100 + hour) + 1] AS description FROM h GROUP BY stadium, day""")
def b14(b):
    hourly = b.table("events").groupBy(
        F.col("user_id").alias("stadium"), F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour")
    ).agg(F.min("value").alias("temp"), F.min(F.col("event_id") % 4).alias("code"))
    out = S.weather_at_kickoff_hour(hourly, ["stadium", "day"], "hour", ["hour", "temp", "code"])
    return rounded(out.select("stadium", "day", F.col("hour").cast("bigint").alias("hour"), "temp", S.weather_text("code").alias("description")))


RISK = """u AS (SELECT *, greatest(p_home, p_draw, p_away) AS lead,
  p_home + p_draw + p_away - greatest(p_home, p_draw, p_away) - least(p_home, p_draw, p_away) AS second FROM forecasts),
 v AS (SELECT *, greatest(0, least(1, (0.7::DOUBLE * lead + 0.3::DOUBLE * (lead - second) - 0.7::DOUBLE / 3) / (1 - 0.7::DOUBLE / 3))) AS conf,
  CASE WHEN p_home = lead THEN 'Home' WHEN p_draw = lead THEN 'Draw' ELSE 'Away' END AS side FROM u)"""


@query("b15_prediction_risk", "WITH " + RISK + " SELECT fixture_id, round(100 * (1 - conf), 6) AS risk, round(conf, 6) AS confidence FROM v", "forecasts")
def b15(b):
    p = ("p_home", "p_draw", "p_away")
    return rounded(b.forecasts.select("fixture_id", S.prediction_risk(*p).alias("risk"), S.prediction_confidence(*p).alias("confidence")))


@query("b16_risk_band", "WITH " + RISK + """ SELECT CASE WHEN r <= 60 THEN 'Low Risk' WHEN r <= 80 THEN 'Moderate Risk' WHEN r <= 92 THEN 'High Risk' ELSE 'Critical Risk' END AS band, count(*) AS n
  FROM (SELECT round(100 * (1 - conf), 9) AS r FROM v) GROUP BY 1""", "forecasts")
def b16(b):
    risk = F.round(S.prediction_risk("p_home", "p_draw", "p_away"), 9)
    banded = b.forecasts.select(S.risk_band(risk).alias("band"))
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("b17_prediction_guidance", "WITH " + RISK + """ SELECT fixture_id, CASE WHEN lead >= 0.65 AND 100 * (1 - conf) <= 60 THEN 'Strong ' || side || ' Lean'
  WHEN lead >= 0.55 AND 100 * (1 - conf) <= 80 THEN 'Consider ' || side ELSE 'No Clear Edge' END AS guidance FROM v""", "forecasts")
def b17(b):
    p = ("p_home", "p_draw", "p_away")
    return b.forecasts.select("fixture_id", S.prediction_guidance(*p, S.prediction_risk(*p)).alias("guidance"))


@query("b18_price_scalars", """SELECT fixture_id, bookmaker, CASE WHEN decimal_price > 1 THEN round_even(CASE WHEN decimal_price >= 2 THEN (decimal_price - 1) * 100 ELSE -100 / (decimal_price - 1) END, 0)::BIGINT END AS american,
   CASE WHEN model_probability * decimal_price - 1 >= 0.12 THEN 'Elite' WHEN model_probability * decimal_price - 1 >= 0.07 THEN 'Strong' WHEN model_probability * decimal_price - 1 >= 0.03 THEN 'Good' ELSE 'Standard' END AS tier,
   round(ln(decimal_price / 2.1::DOUBLE), 6) AS clv FROM opportunities""", "opportunities")
def b18(b):
    price = F.col("decimal_price")
    return rounded(b.opportunities.select(
        "fixture_id", "bookmaker", S.american_odds(price).alias("american"),
        S.value_tier(F.col("model_probability") * price - 1).alias("tier"), S.log_clv(price, F.lit(2.1)).alias("clv"),
    ))


@query("b19_cold_start_status", """SELECT fixture_id, CASE WHEN fixture_id % 13 = 0 THEN 'league_prior' WHEN fixture_id % 13 < 10 THEN 'promoted_or_partial_prior' ELSE 'full_history' END AS badge,
   CASE WHEN fixture_id % 19 = 0 THEN 'promoted_prior' WHEN least(home_team_id % 17, away_team_id % 17) = 0 THEN 'league_prior' WHEN least(home_team_id % 17, away_team_id % 17) < 8 THEN 'partial_history' ELSE 'full' END AS cold_start FROM matches""", "matches")
def b19(b):
    status = F.when(F.col("fixture_id") % 19 == 0, "new_team_prior").otherwise("exact_canonical")
    return b.matches.select(
        "fixture_id", S.cold_start_badge(F.col("fixture_id") % 13).alias("badge"),
        S.forecast_cold_start(F.col("home_team_id") % 17, F.col("away_team_id") % 17, status).alias("cold_start"),
    )


@query("b20_shrinkage_rates", """WITH t AS (SELECT team_id, avg(goals_for) AS m, count(*) AS n, count(*) FILTER (WHERE result = 'W') AS w FROM events2 WHERE goals_for IS NOT NULL GROUP BY team_id)
 SELECT team_id, round(n / (n + 8.0::DOUBLE) * m + (1 - n / (n + 8.0::DOUBLE)) * 1.4::DOUBLE, 6) AS pooled, round((w + 0.4::DOUBLE * 20) / (n + 20), 6) AS win_rate,
   round(n * 90 / (n * 90 + 900.0::DOUBLE) * m, 6) AS per90 FROM t""", "events2")
def b20(b):
    from matchgrain.operators.ledger import team_events

    t = team_events(b.completed).groupBy("team_id").agg(
        F.avg("goals_for").alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("result") == "W").alias("w")
    )
    return rounded(t.select(
        "team_id", S.partial_pool("m", "n", 1.4, 8.0).alias("pooled"), S.beta_binomial_rate("w", "n", 0.4).alias("win_rate"),
        S.minutes_shrunk("m", F.col("n") * 90).alias("per90"),
    ))


@query("b21_transfer_prior", """WITH c AS (SELECT c_custkey AS team_id, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 20) / 10.0::DOUBLE END AS la, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 15) / 10.0::DOUBLE END AS ld,
    (c_custkey % 11) / 10.0::DOUBLE AS w, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 5 - 2) / 10.0::DOUBLE END AS cc, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal / 10000 END AS sv FROM customer)
 SELECT team_id, round(CASE WHEN la IS NULL THEN 1.4::DOUBLE ELSE w * la + (1 - w) * 1.4::DOUBLE END + coalesce(cc, 0) + coalesce(CASE WHEN sv IS NOT NULL THEN greatest(-0.35, least(0.35, sv)) END, 0), 6) AS attack_mean,
   round(CASE WHEN la IS NULL THEN 1.3::DOUBLE ELSE w * ld + (1 - w) * 1.3::DOUBLE END - coalesce(cc, 0) - coalesce(CASE WHEN sv IS NOT NULL THEN greatest(-0.35, least(0.35, sv)) END, 0), 6) AS defense_mean,
   round(CASE WHEN la IS NULL THEN 0 ELSE 8 * w END + CASE WHEN cc IS NULL THEN 0 ELSE 2 END + CASE WHEN sv IS NULL THEN 0 ELSE 3 END, 6) AS effective_matches,
   coalesce(nullif(concat_ws('+', CASE WHEN la IS NOT NULL THEN 'translated_lower_division' END, CASE WHEN cc IS NOT NULL THEN 'country_coefficient' END, CASE WHEN sv IS NOT NULL THEN 'squad_value' END), ''), 'conservative_league_prior') AS provenance FROM c""")
def b21(b):
    k = F.col("c_custkey")
    out = S.transfer_prior(
        1.4, 1.3, F.when(k % 3 > 0, (k % 20) / 10.0), F.when(k % 3 > 0, (k % 15) / 10.0), (k % 11) / 10.0,
        F.when(k % 4 > 0, (k % 5 - 2) / 10.0), F.when(k % 5 > 0, F.col("c_acctbal") / 10000),
    )
    return rounded(b.table("customer").select(k.alias("team_id"), *[c.alias(n) for n, c in out.items()]))


@query("b22_shot_xg_proxy", """SELECT fixture_id, team_id, round(sum(1 / (1 + exp(-(1.65::DOUBLE - 0.105::DOUBLE * distance + 0.012::DOUBLE * (shot_no * 9) - CASE WHEN situation = 'R' THEN 0.45::DOUBLE ELSE 0.15::DOUBLE * -1 END)))), 6) AS xg_proxy
  FROM team_shots GROUP BY fixture_id, team_id""", "team_shots")
def b22(b):
    header = F.col("situation") == "R"
    xg = S.shot_xg_proxy("distance", F.col("shot_no") * 9, header, ~header)
    return rounded(b.team_shots.groupBy("fixture_id", "team_id").agg(F.sum(xg).alias("xg_proxy")))


@query("b23_shot_geometry", """WITH s AS (SELECT fixture_id, shot_no, 100.0::DOUBLE - distance AS x, (fixture_id % 100)::DOUBLE AS y FROM shots)
  SELECT fixture_id, shot_no, round(sqrt((100 - x) * (100 - x) + (y - 50) * (y - 50)), 6) AS distance_to_goal, round(degrees(atan2(abs(y - 50), greatest(100 - x, 1))), 6) AS angle FROM s""", "shots")
def b23(b):
    distance, angle = S.shot_geometry(F.lit(100.0) - F.col("distance"), (F.col("fixture_id") % 100).cast("double"))
    return rounded(b.shots.select("fixture_id", "shot_no", distance.alias("distance_to_goal"), angle.alias("angle")))


@query("b24_action_value", "SELECT fixture_id, shot_no, round(CASE WHEN shot_no % 3 = 0 THEN -greatest(0, xg - 0.1) ELSE xgot - (xg - 0.1) END, 6) AS action_value FROM shots", "shots")
def b24(b):
    return rounded(b.shots.select("fixture_id", "shot_no", S.action_value(F.col("xg") - 0.1, "xgot", F.col("shot_no") % 3 != 0).alias("action_value")))


@query("b25_validate_actions", """SELECT fixture_id, shot_no, false AS bad_ordering, distance * 3 > 105 AS bad_x, distance * 2 > 68 AS bad_y, situation <> 'R' AS bad_type FROM shots""", "shots")
def b25(b):
    rows = b.shots.select(
        "fixture_id", "shot_no", F.col("shot_no").alias("sequence_index"), F.lit(1).alias("period"), F.lit(0.0).alias("seconds_in_period"),
        (F.col("distance") * 3).alias("start_x"), F.lit(None).cast("double").alias("end_x"),
        (F.col("distance") * 2).alias("start_y"), F.lit(0.0).alias("end_y"),
        F.when(F.col("situation") == "R", "shot").otherwise("tackle").alias("action_type"),
    )
    return S.validate_actions(rows).select("fixture_id", "shot_no", *S.action_rules())


@query("b26_pitch_control", """WITH p AS (SELECT fixture_id, is_home, min(sqrt(pow(distance - 50, 2) + pow(shot_no * 8 - 34, 2))) AS d FROM shots GROUP BY ALL)
  SELECT h.fixture_id, round(1 / (1 + exp((h.d / 5 - a.d / 5) * 4)), 6) AS pitch_control FROM p h JOIN p a ON a.fixture_id = h.fixture_id AND NOT a.is_home WHERE h.is_home""", "shots")
def b26(b):
    positions = b.shots.select("fixture_id", F.when(F.col("is_home"), "attack").otherwise("defend").alias("side"), F.col("distance").alias("x"), (F.col("shot_no") * 8).alias("y"))
    targets = b.shots.select("fixture_id", F.lit(50.0).alias("target_x"), F.lit(34.0).alias("target_y")).distinct()
    return rounded(S.pitch_control(positions, targets, ["fixture_id"]).where("pitch_control IS NOT NULL"))


@query("b27_entropy", """SELECT f.fixture_id, round(CASE WHEN p_home <= 0 OR p_home >= 1 THEN 0 ELSE -p_home * log2(p_home) - (1 - p_home) * log2(1 - p_home) END, 6) AS home_bits, round(e.s, 5) AS score_entropy
  FROM forecasts f JOIN (SELECT fixture_id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS s FROM grid GROUP BY fixture_id) e USING (fixture_id)""", "forecasts grid")
def b27(b):
    from matchgrain.operators.grids import poisson_grid

    p = F.col("p")
    e = poisson_grid(b.rates).groupBy("fixture_id").agg((-F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0))).alias("e"))
    f = b.forecasts.select("fixture_id", F.round(S.binary_entropy("p_home"), 6).alias("home_bits"))
    return f.join(e, "fixture_id").select("fixture_id", "home_bits", F.round("e", 5).alias("score_entropy"))


@query("b28_revision_label", """SELECT fixture_id, observed_at, bookmaker, selection, CASE WHEN h >= 168 THEN 'initial' WHEN h >= 24 THEN '24_hour' WHEN h >= 2 THEN 'lineup' WHEN h >= 0 THEN 'closing' ELSE 'late_or_live' END AS label
  FROM (SELECT q.fixture_id, q.observed_at, q.bookmaker, q.selection, (epoch(m.kickoff_utc) - epoch(q.observed_at)) / 3600 - 24 + (q.fixture_id % 30) AS h FROM quotes q JOIN matches m USING (fixture_id))""", "quotes matches")
def b28(b):
    from matchgrain.plans.bridge import shifted

    q = b.quotes.join(b.matches.select("fixture_id", "kickoff_utc"), "fixture_id")
    kick = shifted("kickoff_utc", minutes=(F.col("fixture_id") % 30 - 24) * 60)
    return q.select("fixture_id", "observed_at", "bookmaker", "selection", S.revision_label(kick, "observed_at").alias("label"))


@query("b29_outcome_index", "SELECT fixture_id, CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END AS outcome FROM completed", "completed")
def b29(b):
    return b.completed.select("fixture_id", S.outcome_index("home_goals", "away_goals").alias("outcome"))


@query("b30_assign_phase", """SELECT fixture_id, CASE WHEN month(kickoff_utc) > 8 THEN 'split' ELSE 'regular' END AS phase,
   CASE WHEN coalesce(done, 0) >= 10 THEN 'final' WHEN coalesce(done, 0) >= 6 THEN 'split' ELSE 'regular' END AS phase_at_issue
 FROM matches JOIN (SELECT edition_id, max(CASE WHEN status = 'completed' AND kickoff_utc < TIMESTAMP '1995-09-01' THEN month(kickoff_utc) END) AS done FROM matches GROUP BY edition_id) d USING (edition_id)""", "matches")
def b30(b):
    from matchgrain.operators.windows import phase_at_issue

    rounds = b.matches.withColumn("round", F.month("kickoff_utc"))
    at = phase_at_issue(rounds, F.lit("1995-09-01").cast("timestamp_ntz"), [("regular", None), ("split", 6), ("final", 10)])
    return rounds.join(at, "edition_id").select("fixture_id", S.assign_phase("round", 8).alias("phase"), "phase_at_issue")


@query("b31_phase_points_transition", """SELECT edition_id, team_id, ceil(p / 2.0)::DOUBLE + CASE WHEN team_id % 10 = 0 THEN -3 ELSE 0 END AS halved_up, floor(p / 2.0)::DOUBLE AS halved_down, p * 0.5::DOUBLE AS halved
  FROM (SELECT edition_id, team_id, sum(points) AS p FROM events2 WHERE goals_for IS NOT NULL GROUP BY ALL)""", "events2")
def b31(b):
    from matchgrain.operators.ledger import league_table

    t = league_table(b.matches)
    sanction = F.when(F.col("team_id") % 10 == 0, -3).otherwise(0)
    return t.select(
        "edition_id", "team_id", (S.phase_points("points") + sanction).alias("halved_up"),
        S.phase_points("points", rounding="floor").alias("halved_down"), S.phase_points("points", rounding="none").cast("double").alias("halved"),
    )


@query("b32_apply_scenario", "SELECT fixture_id, round(home_rate - away_rate, 6) AS base_gap, round(2.0 - away_rate, 6) AS scenario_gap, round(2.0 - home_rate, 6) AS delta_gap FROM rates", "rates")
def b32(b):
    score = lambda df: df.withColumn("gap", F.col("home_rate") - F.col("away_rate"))
    out = S.apply_scenario(b.rates, {"home_rate": 2.0}, {"home_rate": (0.1, 5.0)}, score, ["gap"])
    return rounded(out.select("fixture_id", "base_gap", "scenario_gap", "delta_gap"))


@query("b33_experiment_partition", "SELECT fixture_id, 'tuning' AS part FROM matches WHERE kickoff_utc <= TIMESTAMP '1996-01-01' UNION ALL SELECT fixture_id, 'forward' FROM matches WHERE kickoff_utc BETWEEN TIMESTAMP '1996-01-02' AND TIMESTAMP '1997-01-01'", "matches")
def b33(b):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    spec = {"tuning_end": at("1996-01-01"), "forward_start": at("1996-01-02"), "forward_end": at("1997-01-01")}
    parts = [S.experiment_partition(b.matches, p, **spec).select("fixture_id", F.lit(p).alias("part")) for p in ("tuning", "forward")]
    return parts[0].unionByName(parts[1])


@query("b34_search_ledger", "SELECT fixture_id, issued_at, model_id FROM forecasts WHERE edition_id ILIKE '%l7:%' AND model_id = 'm1'", "forecasts")
def b34(b):
    return S.search_ledger(b.forecasts, "L7:", ["edition_id", "model_id"], model="m1").select("fixture_id", "issued_at", "model_id")


@query("b35_season_codes", """SELECT DISTINCT lpad(((y - i) % 100)::VARCHAR, 2, '0') || lpad(((y - i + 1) % 100)::VARCHAR, 2, '0') AS code, year(kickoff_utc) AS year
  FROM (SELECT kickoff_utc, year(kickoff_utc) - (month(kickoff_utc) < 7)::INT AS y FROM matches) CROSS JOIN range(5) t(i)""", "matches")
def b35(b):
    return b.matches.select(F.explode(S.season_codes("kickoff_utc")).alias("code"), F.year("kickoff_utc").cast("bigint").alias("year")).distinct()


@query("b36_normalize_probabilities", "SELECT fixture_id, round(h / (h + d + a), 6) AS p_home, round(d / (h + d + a), 6) AS p_draw, round(a / (h + d + a), 6) AS p_away FROM (SELECT fixture_id, (1 + home_team_id % 7)::DOUBLE AS h, (1 + fixture_id % 3)::DOUBLE AS d, (fixture_id % 5)::DOUBLE AS a FROM matches)", "matches")
def b36(b):
    raw = b.matches.select("fixture_id", (F.lit(1.0) + F.col("home_team_id") % 7).alias("p_home"), (F.lit(1.0) + F.col("fixture_id") % 3).alias("p_draw"), (F.col("fixture_id") % 5).cast("double").alias("p_away"))
    return rounded(S.normalize_probabilities(raw))


@query("b37_quote_status", "SELECT fixture_id, bookmaker, selection, observed_at, (((fixture_id * 7) % 1800))::DOUBLE AS age_seconds, (fixture_id * 7) % 1800 <= 900 AS fresh, (fixture_id * 7) % 1800 <= 900 AND bookmaker % 2 = 0 AS executable_now FROM quotes", "quotes")
def b37(b):
    as_of = F.col("observed_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("fixture_id") * 7 % 1800).cast("decimal(18,6)"))
    return b.quotes.select("fixture_id", "bookmaker", "selection", "observed_at", *[c.alias(n) for n, c in S.quote_status("observed_at", as_of, F.col("bookmaker") % 2 == 0).items()])


@query("b38_estimate_goals", "SELECT fixture_id, round(home_rate * (0.5 + fixture_id % 3) / 1.4, 6) AS home_goals_exp, round(away_rate * (0.5 + fixture_id % 4) / 1.4, 6) AS away_goals_exp FROM rates", "rates")
def b38(b):
    h, a = S.estimate_goals("home_rate", F.lit(0.5) + F.col("fixture_id") % 4, "away_rate", F.lit(0.5) + F.col("fixture_id") % 3, 1.4)
    return rounded(b.rates.select("fixture_id", h.alias("home_goals_exp"), a.alias("away_goals_exp")))


@query("b39_feature_registry_build", "SELECT fixture_id, bookmaker, selection, observed_at, round(decimal_price, 6) AS price, CASE WHEN (epoch(kickoff_utc) - epoch(observed_at)) / 3600 <= 72 THEN (bookmaker * 10)::BIGINT END AS recent_book FROM quotes JOIN matches USING (fixture_id)", "quotes")
def b39(b):
    registry = S.FeatureRegistry()
    registry.register("price", "market", "double", lambda df: df["decimal_price"])
    registry.register("recent_book", "market", "bigint", lambda df: df["bookmaker"] * 10, max_age_hours=72)
    source = b.quotes.join(b.matches.select("fixture_id", "kickoff_utc"), "fixture_id")
    return rounded(registry.build(source, keep=("fixture_id", "bookmaker", "selection", "observed_at")))


@query("b40_manager_advantage", """WITH s AS (SELECT s_suppkey AS manager_id, (s_suppkey % 10) / 10.0::DOUBLE AS r FROM supplier WHERE s_suppkey % 2 = 0)
  SELECT fixture_id, round(coalesce(h.r, 0.45) - coalesce(a.r, 0.45), 6) AS win_rate_diff, round(coalesce(h.r * 2, 1.4) - coalesce(a.r * 2, 1.4), 6) AS goals_per_game_diff
  FROM matches LEFT JOIN s h ON h.manager_id = home_team_id % 50 LEFT JOIN s a ON a.manager_id = away_team_id % 50""", "matches")
def b40(b):
    from matchgrain.operators.joins import manager_advantage

    key = F.col("s_suppkey")
    stats = b.table("supplier").where(key % 2 == 0).select(key.alias("manager_id"), ((key % 10) / 10.0).alias("win_rate"), ((key % 10) / 10.0 * 2).alias("goals_per_game"))
    m = b.matches.select("fixture_id", (F.col("home_team_id") % 50).alias("home_manager_id"), (F.col("away_team_id") % 50).alias("away_manager_id"))
    return rounded(manager_advantage(m, stats, {"win_rate": 0.45, "goals_per_game": 1.4}).select("fixture_id", "win_rate_diff", "goals_per_game_diff"))


@query("b41_capability_status", """WITH r AS (SELECT event_type AS provider, user_id, max(ts) AS seen, count(*) / 20.0 AS coverage, bool_or(value < 0.5) AS failed FROM events GROUP BY ALL)
  SELECT provider, user_id, CASE WHEN failed THEN 'failed' WHEN epoch(TIMESTAMP '2024-02-01') - epoch(seen) > 604800 THEN 'stale' WHEN coverage >= 0.999 THEN 'available' ELSE 'degraded' END AS status FROM r""")
def b41(b):
    runs = b.table("events").groupBy(F.col("event_type").alias("provider"), "user_id").agg(
        F.max("ts").alias("seen"), (F.count(F.lit(1)) / 20.0).alias("coverage"), F.bool_or(F.col("value") < 0.5).alias("failed")
    )
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return runs.select("provider", "user_id", S.capability_status("failed", "coverage", "seen", now, 604800).alias("status"))


@query("b42_first_present_column", "SELECT fixture_id, round(home_xg, 6) AS xg FROM matches_xg", "matches_xg")
def b42(b):
    from matchgrain.functions.contracts import first_present

    m = b.matches_xg.withColumnRenamed("home_xg", "xg_home")
    return rounded(m.select("fixture_id", F.col(first_present(m, "home_xg", "xg_home")).alias("xg")))


@query("b43_optional_source_columns", "SELECT m.fixture_id, round(s.xg, 6) AS shots_xg, s.n AS shots_n FROM matches m LEFT JOIN (SELECT fixture_id, sum(xg) AS xg, count(*) AS n FROM shots GROUP BY 1) s USING (fixture_id)", "matches shots")
def b43(b):
    source = b.shots.groupBy("fixture_id").agg(F.sum("xg").alias("xg"), F.count(F.lit(1)).alias("n"))
    base = S.optional_source_columns(b.matches.select("fixture_id"), None, ["fixture_id"], "absent")
    return rounded(S.optional_source_columns(base, source, ["fixture_id"], "shots"))


@query("b44_rating_win_probability", "SELECT fixture_id, round(1 / (1 + pow(10, ((1400 + away_team_id % 200) - (1400 + home_team_id % 200) - 55) / 400.0)), 6) AS elo_form, round(1 / (1 + exp(-((home_team_id % 9 - away_team_id % 9) / 10.0 + 0.15))), 6) AS natural_form FROM matches", "matches")
def b44(b):
    r = lambda t: F.lit(1400) + F.col(t) % 200
    return rounded(b.matches.select(
        "fixture_id", S.elo_expected(r("home_team_id"), r("away_team_id"), 55.0).alias("elo_form"),
        S.logistic_expected((F.col("home_team_id") % 9 - F.col("away_team_id") % 9) / 10.0, 0.15).alias("natural_form"),
    ))


@query("b45_covariate_differences", "SELECT fixture_id, (home_team_id % 20 - away_team_id % 20)::DOUBLE AS rank_difference, 7.5::DOUBLE AS elo_difference FROM matches", "matches")
def b45(b):
    m = b.matches.select("fixture_id", (F.col("home_team_id") % 20).alias("home_rank"), (F.col("away_team_id") % 20).alias("away_rank"),
                         F.lit(1).alias("home_elo"), F.lit(2).alias("away_elo"), F.lit(7.5).alias("elo_difference"))
    return S.covariate_differences(m).select("fixture_id", "rank_difference", "elo_difference")
