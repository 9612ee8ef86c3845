"""Source and payload queries; the nested payloads are built by Spark from the given tables.

Payload rows are pages of a bounded id range, as a provider would page them, so a payload
never holds an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrain.functions.storage import shared_folder
from matchgrain.plans.registry import query, rounded
from matchgrain.sources import pages as pg
from matchgrain.sources import payloads as py
from matchgrain.sources import tables as tb


def history_frame(b):
    gap = F.col("home_goals") - F.col("away_goals")
    return b.matches.select(
        F.concat(F.lit("L"), F.col("league_id").cast("string")).alias("Div"), F.date_format("kickoff_utc", "dd/MM/yyyy").alias("Date"), F.date_format("kickoff_utc", "HH:mm").alias("Time"),
        F.col("home_team_id").cast("string").alias("HomeTeam"), F.col("away_team_id").cast("string").alias("AwayTeam"), F.col("home_goals").alias("FTHG"), F.col("away_goals").alias("FTAG"),
        F.when(gap > 0, "H").when(gap == 0, "D").when(gap < 0, "A").alias("FTR"), F.col("fixture_id").cast("string").alias("Source"),
    )


def history_path(b) -> str:
    import hashlib

    tag = hashlib.sha256(b.sf_dir.encode()).hexdigest()[:10]
    path = f"{shared_folder(b.spark)}/history-{b.spark.sparkContext.applicationId}-{tag}"
    b.stored("history-file", lambda: _written(b, path))
    return path


def _written(b, path):
    tb.write_history(history_frame(b), path)
    return b.spark.range(1)


@query("a1_read_history", """SELECT CAST(fixture_id AS VARCHAR) AS "Source", 'L' || league_id AS "Division", strftime(kickoff_utc, '%d/%m/%Y') AS "MatchDate", home_goals::INT AS "FullTimeHomeGoals", CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' WHEN home_goals < away_goals THEN 'A' END AS "FullTimeResult" FROM matches""", "matches")
def a1(b):
    return tb.read_history(b.spark, history_path(b)).select("Source", "Division", "MatchDate", "FullTimeHomeGoals", "FullTimeResult")


@query("a1_prepare_history", """SELECT edition, count(*) AS matches, sum(home_goals)::BIGINT AS goals, min(kickoff_utc) AS first_kickoff FROM (SELECT *, 'lg:' || (year(kickoff_utc) - (month(kickoff_utc) < 7)::INT) || '-' || lpad(((year(kickoff_utc) - (month(kickoff_utc) < 7)::INT + 1) % 100)::VARCHAR, 2, '0') AS edition FROM completed) GROUP BY 1""", "completed")
def a1_prepared(b):
    m = tb.prepare_history(tb.read_history(b.spark, history_path(b)), league="lg", zone="UTC")
    return m.groupBy(F.col("edition_id").alias("edition")).agg(F.count(F.lit(1)).alias("matches"), F.sum("home_goals").alias("goals"), F.min("kickoff_utc").cast("timestamp_ntz").alias("first_kickoff"))


@query("a2_union_seasons", """SELECT CAST(fixture_id AS VARCHAR) AS "Source", CAST(kickoff_utc AS DATE) AS "MatchDate", 'lg' AS "League", CASE WHEN year(kickoff_utc) > 1995 THEN 1 END AS "Extra" FROM matches""", "matches")
def a2(b):
    h = tb.read_history(b.spark, history_path(b))
    late = F.substring("MatchDate", -4, 4).cast("int") > 1995
    out = tb.union_seasons({"early": h.where(~late), "late": h.where(late).withColumn("Extra", F.lit(1)), "bad": h.drop("FullTimeResult")}, "lg")
    return out.select("Source", "MatchDate", "League", "Extra")


@query("a3_read_table_by_format", "SELECT * FROM orders")
def a3(b):
    return tb.read_table(b.spark, f"{b.sf_dir}/orders.parquet")


@query("a4_write_table", "SELECT count(*) AS written, count(*) AS read_back FROM matches", "matches")
def a4(b):
    path = f"{shared_folder(b.spark)}/written-{b.spark.sparkContext.applicationId}"
    n = tb.write_table(b.matches, path, partition_by=["league_id"])
    return b.spark.read.parquet(path).agg(F.lit(n).cast("bigint").alias("written"), F.count(F.lit(1)).alias("read_back"))


def nested(b):
    """Shots of a fixture nested by period; a fixture has few shots by nature."""
    shot = F.struct(
        F.col("shot_no").alias("shot_no"), "team_id", F.when(F.col("shot_no") != 3, F.col("xg")).alias("xg"),
        F.struct((F.col("fixture_id") * 10 + F.col("shot_no")).alias("id"), F.concat(F.lit("P"), F.col("shot_no").cast("string")).alias("name")).alias("player"),
    )
    per = b.team_shots.withColumn("number", F.when(F.col("shot_no") <= 3, 1).otherwise(2)).groupBy("fixture_id", "home_team_id", "away_team_id", "number").agg(F.collect_list(shot).alias("shots"))
    return per.groupBy(F.col("fixture_id").alias("match_id"), F.col("home_team_id").alias("home_id"), F.col("away_team_id").alias("away_id")).agg(F.collect_list(F.struct("number", "shots")).alias("periods"))


@query("a5_flatten_shots", "SELECT fixture_id AS match_id, CASE WHEN shot_no <= 3 THEN 1 ELSE 2 END AS period, shot_no, team_id, CASE WHEN shot_no <> 3 THEN round(xg, 6) END AS xg, fixture_id * 10 + shot_no AS player_id, 'P' || shot_no AS player_name FROM team_shots", "team_shots")
def a5(b):
    return rounded(py.flatten_shots(nested(b)).drop("home_id", "away_id"))


@query("a6_match_xg_from_shots", "SELECT fixture_id AS match_id, round(round(sum(CASE WHEN is_home AND shot_no <> 3 THEN xg ELSE 0 END), 9), 4) AS home_xg, round(round(sum(CASE WHEN NOT is_home AND shot_no <> 3 THEN xg ELSE 0 END), 9), 4) AS away_xg FROM team_shots GROUP BY 1", "team_shots")
def a6(b):
    return py.match_xg_from_shots(py.flatten_shots(nested(b)))


@query("a7_flatten_nested_stats", """SELECT fixture_id, home_goals AS "goals.home.total", away_goals AS "goals.away.total", status AS "meta.status" FROM matches""", "matches")
def a7(b):
    s = F.struct(
        F.struct(F.struct(F.col("home_goals").alias("total")).alias("home"), F.struct(F.col("away_goals").alias("total")).alias("away")).alias("goals"), F.struct("status").alias("meta"),
    )
    return py.flatten_nested(b.matches.select("fixture_id", s.alias("stats")), "stats", ["fixture_id"])


def detail(b):
    player = F.col("fixture_id") * 10 + F.col("shot_no")
    shot = F.struct(
        F.col("shot_no").alias("minute"), F.lit("open").alias("sit"), F.col("is_home").alias("home"), F.struct(F.col("distance").alias("x"), F.lit(50.0).alias("y")).alias("pos"),
        F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).alias("gm"), "xg", "xgot", player.alias("pid"),
    )
    point = F.struct(F.col("shot_no").alias("minute"), (F.col("xg") - F.col("xgot")).alias("value"))
    spot = F.struct(player.alias("player_id"), F.col("distance").alias("x"), F.lit(34.0).alias("y"))
    g = b.shots.groupBy(F.col("fixture_id").alias("match_id")).agg(
        F.collect_list(shot).alias("shots"), F.collect_list(point).alias("momentum"),
        F.struct(F.collect_list(F.when(F.col("is_home"), spot)).alias("home"), F.collect_list(F.when(~F.col("is_home"), spot)).alias("away")).alias("positions"),
        F.struct(F.sum(F.when(F.col("is_home"), F.col("xg"))).alias("home"), F.sum(F.when(~F.col("is_home"), F.col("xg"))).alias("away")).alias("xg"),
    )
    names = b.matches.select(F.col("fixture_id").alias("match_id"), F.concat(F.lit("T"), F.col("home_team_id").cast("string")).alias("home_team"))
    return g.join(names, "match_id").withColumn("odds", F.struct(F.lit(2.0).alias("home"), F.lit(4.0).alias("draw"), F.lit(3.0).alias("away")))


@query("a8_flatten_match_detail", """SELECT fixture_id AS match_id, 'T' || home_team_id AS home_team, shot_no::INT AS minute, 'open' AS situation, is_home, round(xg, 6) AS xg, round(xgot, 6) AS xgot, round(distance, 6)::DOUBLE AS x, 50::DOUBLE AS y, fixture_id * 10 + shot_no AS player_id FROM shots JOIN matches USING (fixture_id)""", "shots matches")
def a8(b):
    return rounded(py.flatten_match_detail(detail(b))["shots"].select("match_id", "home_team", "minute", "situation", "is_home", "xg", "xgot", "x", "y", "player_id"))


@query("a8_flatten_match_positions", """SELECT fixture_id AS match_id, CASE WHEN is_home THEN 'home' ELSE 'away' END AS side, fixture_id * 10 + shot_no AS player_id, round(distance, 6)::DOUBLE AS x FROM shots""", "shots")
def a8_positions(b):
    return rounded(py.flatten_match_detail(detail(b))["positions"].select("match_id", "side", "player_id", "x"))


@query("a8_flatten_match_row", """SELECT fixture_id AS match_id, round(sum(xg) FILTER (WHERE is_home), 6) AS home_xg, round(sum(xg) FILTER (WHERE NOT is_home), 6) AS away_xg, 2::DOUBLE AS home_odds, 4::DOUBLE AS draw_odds, NULL::DOUBLE AS over_25_odds FROM shots GROUP BY 1""", "shots")
def a8_row(b):
    return rounded(py.flatten_match_detail(detail(b))["match"].select("match_id", "home_xg", "away_xg", "home_odds", "draw_odds", "over_25_odds"))


@query("a9_flatten_player_stats", "SELECT l_partkey AS player_id, 'n' || l_partkey AS player_name, l_orderkey AS event_id, strftime(l_shipdate, '%Y-%m-%d') AS event_date, l_quantity AS passes, round(l_discount, 6) AS rating FROM lineitem")
def a9(b):
    j = F.to_json(F.struct(
        F.struct(F.col("l_partkey").alias("id"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("name")).alias("player"),
        F.struct(F.col("l_orderkey").alias("id"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T12:00:00Z")).alias("date")).alias("event"),
        F.struct(F.col("l_quantity").alias("passes"), F.col("l_discount").alias("rating")).alias("stats"),
    ))
    return rounded(py.flatten_player_stats(b.table("lineitem").select(j.alias("payload")), ["passes", "rating"]))


@query("a10_flatten_standings", "SELECT s_nationkey AS league_id, s_suppkey AS team_id, s_name AS team_name, s_suppkey % 10 AS points, s_suppkey % 7 AS home_win FROM supplier")
def a10(b):
    k = F.col("s_suppkey")
    split = lambda: F.struct(F.lit(1).alias("played"), (k % 7).alias("win"), F.lit(0).alias("draw"), F.lit(0).alias("lose"))
    row = F.struct(k.alias("rank"), F.struct(k.alias("id"), F.col("s_name").alias("name")).alias("team"), (k % 10).alias("points"), split().alias("all"), split().alias("home"), split().alias("away"))
    league = b.table("supplier").groupBy(F.col("s_nationkey").alias("league_id"), F.floor(k / 50).alias("page")).agg(F.array(F.collect_list(row)).alias("standings"))
    return py.flatten_standings(league).select("league_id", "team_id", "team_name", "points", "home_win")


@query("a11_flatten_fixtures", "SELECT fixture_id AS event_id, kickoff_utc - INTERVAL 9 HOUR AS kickoff_utc, 'team ' || home_team_id AS home_key FROM matches WHERE status = 'scheduled'", "matches")
def a11(b):
    side = lambda s: F.struct(F.lit(s).alias("homeAway"), F.concat(F.lit("Team "), F.col(f"{s}_team_id").cast("string")).alias("name"))
    event = F.struct(F.col("fixture_id").alias("id"), "status", F.date_format("kickoff_utc", "yyyy-MM-dd HH:mm").alias("local_time"), F.array(side("away"), side("home")).alias("competitors"))
    payload = b.matches.groupBy(F.col("league_id").cast("string").alias("league"), F.floor(F.col("fixture_id") / 500).alias("page")).agg(F.collect_list(event).alias("events"))
    out = py.flatten_fixtures(payload, zone="Asia/Tokyo")
    return out.select("event_id", F.col("kickoff_utc").cast("timestamp_ntz").alias("kickoff_utc"), "home_key")


@query("a12_flatten_injuries", """SELECT 'P' || event_id AS "Player", coalesce(n_name, 't' || user_id % 60) AS "Team", event_type AS "Reason" FROM events LEFT JOIN nation ON n_nationkey = user_id % 60""")
def a12(b):
    item = F.struct(
        F.struct(F.concat(F.lit("P"), F.col("event_id").cast("string")).alias("name"), F.col("event_type").alias("reason")).alias("player"),
        F.struct(F.concat(F.lit("t"), (F.col("user_id") % 60).cast("string")).alias("name")).alias("team"), F.struct(F.col("ts").cast("string").alias("date")).alias("fixture"),
    )
    payload = b.table("events").groupBy(F.floor(F.col("event_id") / 200).alias("page")).agg(F.collect_list(item).alias("response"))
    aliases = b.table("nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_name").alias("team_name"), F.lit(1).alias("priority"))
    return py.flatten_injuries(payload, aliases).select("Player", "Team", "Reason")


def books(b):
    return b.quotes.groupBy("fixture_id", "bookmaker", "selection").agg(F.max("decimal_price").alias("price"))


@query("a13_normalize_odds", "SELECT fixture_id, 'px' AS provider, 'book' || bookmaker AS market, selection, round(max(decimal_price), 6) AS decimal_price FROM quotes GROUP BY ALL", "quotes")
def a13(b):
    outcome = F.struct(F.col("selection").alias("name"), "price")
    m = books(b).groupBy("fixture_id", "bookmaker").agg(F.collect_list(outcome).alias("outcomes"))
    payload = m.groupBy("fixture_id").agg(F.collect_list(F.struct(F.concat(F.lit("book"), F.col("bookmaker").cast("string")).alias("name"), "outcomes")).alias("markets"))
    return rounded(py.normalize_odds(payload, "px"))


@query("a14_goal_difference_to_1x2", "SELECT fixture_id, round((0.2::DOUBLE + (fixture_id % 10) / 100.0), 4) AS \"p_H\", round((fixture_id % 7) / 100.0::DOUBLE, 4) AS \"p_D\", round(0.3::DOUBLE, 4) AS \"p_A\" FROM matches", "matches")
def a14(b):
    k = F.col("fixture_id")
    wide = b.matches.select("fixture_id", F.lit(0.1).alias("GD=-2"), F.lit(0.2).alias("GD=-1"), ((k % 7) / 100.0).alias("GD=0"), F.lit(0.2).alias("GD=1"), ((k % 10) / 100.0).alias("GD=2"), F.lit(None).cast("double").alias("GD=3"), F.lit(0.9).alias("Elo"))
    return py.goal_difference_to_1x2(wide, ["fixture_id"])


@query("a15_extract_official_records", """SELECT strftime(kickoff_utc, '%Y-%m-%d') AS "Date", 'T' || home_team_id AS "HomeTeam", 'T' || away_team_id AS "AwayTeam", 'R' || (fixture_id % 40) AS "Referee", 'A' || (fixture_id % 50) AS "AssistantReferee1", NULL::VARCHAR AS "AssistantReferee2", 'F' AS "FourthOfficial", 'V' || (fixture_id % 30) AS "VAR", NULL::VARCHAR AS "AVAR" FROM matches WHERE fixture_id % 3 > 0""", "matches")
def a15(b):
    """Every second payload holds its matches seven levels down."""
    t = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k = F.col("fixture_id")
    m = F.struct(
        F.date_format("kickoff_utc", "yyyy-MM-dd").alias("kickoff"), t("T", F.col("home_team_id")).alias("home"), t("T", F.col("away_team_id")).alias("awayTeam"),
        F.when(k % 3 > 0, t("R", k % 40)).alias("official"), t("A", k % 50).alias("assistantReferee1"), F.lit("F").alias("fourthOfficial"), t("V", k % 30).alias("videoAssistantReferee"),
    )
    shallow = F.to_json(F.struct(F.struct(F.array(m).alias("fixtures")).alias("page")))
    deep = F.struct(F.array(m).alias("matches"))
    for name in ("e", "d", "c", "b", "a"):
        deep = F.struct(deep.alias(name))
    return py.extract_official_records(b.matches.select(F.when(k % 2 == 0, shallow).otherwise(F.to_json(deep)).alias("payload")))


@query("a16_extract_page_fields", r"""SELECT page_id, url, nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') AS title FROM pages""")
def a16(b):
    return pg.extract_page_fields(b.table("pages")).select("page_id", "url", "title")


@query("a16_extract_match_pages", "SELECT fixture_id, 'T' || home_team_id AS home_team, 'T' || away_team_id AS away_team, strftime(kickoff_utc, '%Y-%m-%d') AS match_date, 'Ref ' || (fixture_id % 40) AS referee FROM matches", "matches")
def a16_match(b):
    day = F.date_format("kickoff_utc", "yyyy-MM-dd")
    title = F.concat(F.lit("<title>T"), F.col("home_team_id").cast("string"), F.lit(" vs T"), F.col("away_team_id").cast("string"), F.lit("</title>"))
    odd = F.col("fixture_id") % 2 == 1
    date = F.when(odd, F.concat(F.lit('<span class="match-date">'), day, F.lit("</span>"))).otherwise(F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T10:00">')))
    ref = F.concat(F.lit("Ref "), (F.col("fixture_id") % 40).cast("string"))
    who = F.when(odd, F.concat(F.lit('<p class="referee">'), ref, F.lit("</p>"))).otherwise(F.concat(F.lit("<p>Referee: "), ref, F.lit("</p>")))
    return pg.extract_page_fields(b.matches.select("fixture_id", F.concat(title, date, who).alias("html"))).select("fixture_id", "home_team", "away_team", "match_date", "referee")


@query("a18_flatten_top_players", "SELECT user_id AS player_id, user_id::VARCHAR AS player_name, (user_id % 20)::INT AS age, NULL::VARCHAR AS nationality, event_type AS team_name, upper(event_type) AS team, 'M' AS position, count(*) AS appearances, count(*) AS minutes, 7.5::DOUBLE AS rating, count(*) AS goals, count(*) AS assists, NULL::BIGINT AS shots, NULL::BIGINT AS shots_on_target, 3::BIGINT AS key_passes, NULL::DOUBLE AS pass_accuracy, NULL::BIGINT AS tackles, NULL::BIGINT AS dribbles, count(*) AS yellow_cards, NULL::BIGINT AS red_cards, category FROM events CROSS JOIN (VALUES ('scorers'), ('assists')) k(category) GROUP BY ALL")
def a18(b):
    per = b.table("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    stat = F.struct(
        F.struct(F.col("event_type").alias("name")).alias("team"), F.struct(n.alias("total"), n.alias("assists")).alias("goals"),
        F.struct(n.alias("minutes"), n.alias("appearences"), F.lit("M").alias("position"), F.lit("7.5").alias("rating")).alias("games"),
        F.struct(F.lit(3).alias("key")).alias("passes"), F.struct(n.alias("yellow")).alias("cards"),
    )
    who = F.struct(F.col("user_id").alias("id"), F.col("user_id").cast("string").alias("name"), (F.col("user_id") % 20).alias("age"))
    players = per.groupBy("user_id").agg(F.collect_list(stat).alias("statistics")).select(who.alias("player"), "statistics")
    return py.flatten_top_players({"scorers": players, "assists": players}, F.upper("team_name"))


@query("a19_flatten_team_statistics", "SELECT c_custkey AS team_id, c_custkey % 38 AS played, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 20 END, 0) AS wins, 0::BIGINT AS draws, c_custkey % 11 AS away_wins, c_custkey % 60 AS goals_for, 0::BIGINT AS goals_against, 1.5::DOUBLE AS goals_for_avg_home, 0::DOUBLE AS goals_for_avg_away, 0::BIGINT AS clean_sheets, 0::BIGINT AS penalties_scored, c_custkey % 5 AS longest_wins, 'WDL' AS form, '' AS biggest_win_home, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 9 END AS goals_0_15, NULL::BIGINT AS goals_76_90, NULL::BIGINT AS goals_against_76_90, '4-3-3' AS formation FROM customer")
def a19(b):
    k = F.col("c_custkey")
    goals = F.struct(F.struct(F.struct((k % 60).alias("total")).alias("total"), F.struct(F.lit("1.5").alias("home")).alias("average"), F.when(k % 2 == 0, F.create_map(F.lit("0-15"), F.struct((k % 9).alias("total")))).alias("minute")).alias("for"))
    stats = F.struct(
        F.struct(F.struct((k % 38).alias("total")).alias("played"), F.struct(F.when(k % 3 > 0, k % 20).alias("total"), (k % 11).alias("away")).alias("wins")).alias("fixtures"), goals.alias("goals"),
        F.struct(F.lit(None).cast("bigint").alias("total")).alias("clean_sheet"), F.struct(F.struct((k % 5).alias("wins")).alias("streak")).alias("biggest"), F.lit("WDL").alias("form"),
        F.array(F.struct(F.lit("4-3-3").alias("formation"))).alias("lineups"),
    )
    out = py.flatten_team_statistics(b.table("customer").select(k.alias("team_id"), stats.alias("stats")))
    return out.select("team_id", "played", "wins", "draws", "away_wins", "goals_for", "goals_against", "goals_for_avg_home", "goals_for_avg_away", "clean_sheets", "penalties_scored", "longest_wins", "form", "biggest_win_home", "goals_0_15", "goals_76_90", "goals_against_76_90", "formation")


@query("a20_flatten_coaches", "SELECT team_id, NULL::BIGINT AS coach_id, 'c' AS coach_name, (team_id % 30 + 35)::INT AS age, 'n' AS nationality, coalesce(max(CASE WHEN effective_to IS NULL THEN strftime(effective_from, '%Y-%m-%d') END), '') AS start_date, count(*)::INT AS clubs FROM tenures GROUP BY 1", "tenures")
def a20(b):
    entry = F.struct(F.date_format("effective_from", "yyyy-MM-dd").alias("start"), F.date_format("effective_to", "yyyy-MM-dd").alias("end"))
    coaches = b.tenures.groupBy("team_id").agg(F.collect_list(entry).alias("career"), F.lit("c").alias("coach_name"), F.lit("n").alias("nationality"))
    return py.flatten_coaches(coaches.withColumn("age", F.col("team_id") % 30 + 35))


@query("a20_flatten_squads", "SELECT DISTINCT user_id AS team_id, event_id AS player_id, 'p' || event_id AS player_name, (event_id % 20 + 17)::INT AS age, NULL::INT AS number, event_type AS position FROM events")
def a20_squads(b):
    k = F.col("event_id")
    player = F.struct(k.alias("id"), F.concat(F.lit("p"), k.cast("string")).alias("name"), (k % 20 + 17).alias("age"), F.col("event_type").alias("position"))
    return py.flatten_squads(b.table("events").groupBy(F.col("user_id").alias("team_id"), F.floor(k / 2000).alias("page")).agg(F.collect_list(player).alias("players")))


@query("a21_flatten_transfers", "SELECT o_custkey AS player_id, 'p' || o_custkey AS player_name, CAST(o_orderdate AS DATE) AS transfer_date, o_orderpriority AS type, 'a' AS team_in, '' AS team_out FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01'")
def a21(b):
    teams = F.struct(F.struct(F.lit("a").alias("name")).alias("in"), F.struct(F.lit(None).cast("string").alias("name")).alias("out"))
    t = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("type"), teams.alias("teams"))
    payload = b.table("orders").groupBy(F.col("o_custkey").alias("player_id"), F.floor(F.col("o_orderkey") / 1000).alias("page")).agg(F.collect_list(t).alias("transfers"))
    payload = payload.withColumn("player_name", F.concat(F.lit("p"), F.col("player_id").cast("string")))
    return py.flatten_transfers(payload, F.lit("1998-07-01").cast("date"))


@query("a22_flatten_provider_predictions", "SELECT fixture_id, fixture_id % 9 AS winner_id, 'w' AS winner_name, fixture_id % 2 = 0 AS win_or_draw, '-2.5' AS under_over, '-1.5' AS goals_home, NULL::VARCHAR AS goals_away, 'a' AS advice, (fixture_id % 100)::DOUBLE AS pct_home, (fixture_id % 90)::DOUBLE AS pct_draw, (fixture_id % 80)::DOUBLE AS pct_away, (fixture_id % 60)::DOUBLE AS form_home, (fixture_id % 50)::DOUBLE AS form_away, (fixture_id % 60)::DOUBLE AS att_home, (fixture_id % 50)::DOUBLE AS att_away, (fixture_id % 60)::DOUBLE AS def_home, (fixture_id % 50)::DOUBLE AS def_away, (fixture_id % 4)::INT AS past_meetings FROM matches", "matches")
def a22(b):
    k = F.col("fixture_id")
    p = lambda n: F.concat((k % n).cast("string"), F.lit("%"))
    pair = lambda: F.struct(p(60).alias("home"), p(50).alias("away"))
    told = F.struct(
        F.struct((k % 9).alias("id"), F.lit("w").alias("name")).alias("winner"), (k % 2 == 0).alias("win_or_draw"), F.lit("-2.5").alias("under_over"),
        F.struct(F.lit("-1.5").alias("home")).alias("goals"), F.lit("a").alias("advice"), F.struct(p(100).alias("home"), p(90).alias("draw"), p(80).alias("away")).alias("percent"),
    )
    df = b.matches.select(
        "fixture_id", told.alias("predictions"), F.struct(pair().alias("form"), pair().alias("att"), pair().alias("def")).alias("comparison"),
        F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (k % 4).cast("int")).alias("h2h"),
    )
    return py.flatten_predictions(df)


@query("a23_flatten_prematch_odds", "SELECT fixture_id, 'b' || bookmaker AS bookmaker, 'Match Winner' AS market, selection, round(max(decimal_price), 6) AS decimal_price FROM quotes GROUP BY ALL", "quotes")
def a23(b):
    v = F.struct(F.col("selection").alias("value"), F.col("price").cast("string").alias("odd"))
    bets = books(b).groupBy("fixture_id", "bookmaker").agg(F.collect_list(v).alias("values"))
    book = F.struct(F.concat(F.lit("b"), F.col("bookmaker").cast("string")).alias("name"), F.array(F.struct(F.lit("Match Winner").alias("name"), "values")).alias("bets"))
    return rounded(py.flatten_prematch_odds(bets.groupBy("fixture_id").agg(F.collect_list(book).alias("bookmakers"))))


@query("a24_extract_table_rows", "SELECT fixture_id, 1 AS row_no, strftime(kickoff_utc, '%d/%m') AS match_date, 'H' || home_team_id AS home_team, 'A' || away_team_id AS away_team, 'R' || (fixture_id % 40) AS referee FROM matches", "matches")
def a24(b):
    td = lambda c: F.concat(F.lit("<td> <b>"), c, F.lit("</b></td>"))
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    row = F.concat(td(F.date_format("kickoff_utc", "dd/MM")), td(s("H", F.col("home_team_id"))), td(F.lit("15:00")), td(s("A", F.col("away_team_id"))), td(s("R", F.col("fixture_id") % 40)))
    page = F.concat(F.lit("<table><tr><th>x</th></tr></table><table><tr><th>Date</th><th>Referees</th></tr><tr>"), row, F.lit("</tr><tr><td>short</td></tr></table>"))
    return pg.extract_table_rows(b.matches.select("fixture_id", page.alias("html")))


@query("a24_extract_table_rows_pages")
def a24_pages(b):
    """The given pages hold no such table, so the answer is their empty set of rows beside the page count."""
    rows = pg.extract_table_rows(b.table("pages"))
    return b.table("pages").agg(F.count(F.lit(1)).alias("pages")).withColumn("rows", rows.agg(F.count(F.lit(1))).scalar())
