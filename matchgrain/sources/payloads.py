"""Nested provider payloads to flat tables: explodes and struct projections, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrain.functions.contracts import guard
from matchgrain.functions.storage import cut_lineage


def flatten_shots(matches: DataFrame) -> DataFrame:
    """A5: (match_id, home_id, away_id, periods[].shots[].player) to one row per shot."""
    periods = matches.select("match_id", "home_id", "away_id", F.explode("periods").alias("period"))
    shots = periods.select("match_id", "home_id", "away_id", F.col("period.number").alias("period"), F.explode("period.shots").alias("shot"))
    return shots.select(
        "match_id", "home_id", "away_id", "period", F.col("shot.shot_no").alias("shot_no"), F.col("shot.team_id").alias("team_id"),
        F.col("shot.xg").alias("xg"), F.col("shot.player.id").alias("player_id"), F.col("shot.player.name").alias("player_name"),
    )


def match_xg_from_shots(shots: DataFrame, *, exact_away: bool = False) -> DataFrame:
    """xG per side, rounded to 4; a null xG is 0. Every shot that is not the home side's
    counts as away, unless `exact_away` asks for the away team's id."""
    xg = F.coalesce(F.col("xg"), F.lit(0.0))
    home = F.col("team_id") == F.col("home_id")
    away = F.col("team_id") == F.col("away_id") if exact_away else ~F.coalesce(home, F.lit(False))
    side = lambda c: F.round(F.sum(F.when(c, xg).otherwise(0.0)), 4)
    return shots.groupBy("match_id").agg(side(home).alias("home_xg"), side(away).alias("away_xg"))


def flatten_nested(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Leaves of a struct as dotted columns `group.key.subkey`, from the schema alone."""
    leaves: list[Column] = []

    def walk(kind: T.DataType, path: list[str]) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                walk(field.dataType, [*path, field.name])
        else:
            col = F.col(column)
            for part in path:
                col = col[part]
            leaves.append(col.alias(".".join(path)))

    walk(df.schema[column].dataType, [])
    return df.select(*keep, *leaves)


# Output column, place in the payload, kind.
MATCH_FIELDS = (
    ("match_date", "event_date", "string"), ("home_team", "home_team", "string"), ("away_team", "away_team", "string"), ("home_score", "home_score", "int"),
    ("away_score", "away_score", "int"), ("home_score_ht", "home_score_ht", "int"), ("away_score_ht", "away_score_ht", "int"), ("home_xg", "xg.home", "double"),
    ("away_xg", "xg.away", "double"), ("home_odds", "odds.home", "double"), ("draw_odds", "odds.draw", "double"), ("away_odds", "odds.away", "double"),
    ("over_25_odds", "odds.over_25", "double"), ("btts_yes_odds", "odds.btts_yes", "double"), ("round_number", "round_number", "int"),
)
SHOT_FIELDS = (
    ("minute", "minute", "int"), ("type", "type", "string"), ("situation", "sit", "string"), ("body_part", "body", "string"), ("is_home", "home", "boolean"),
    ("xg", "xg", "double"), ("xgot", "xgot", "double"), ("x", "pos.x", "double"), ("y", "pos.y", "double"), ("goal_x", "gm.x", "double"), ("goal_y", "gm.y", "double"),
    ("goal_z", "gm.z", "double"), ("goal_location", "gml", "string"), ("player_id", "pid", "bigint"),
)
PLACE_FIELDS = (("player", "player", "string"), ("player_id", "player_id", "bigint"), ("number", "number", "int"), ("x", "x", "double"), ("y", "y", "double"))
SIDE_FIELDS = ("match_date", "home_team", "away_team")


def flatten_match_detail(matches: DataFrame) -> dict[str, DataFrame]:
    """Match payload to match, shot, momentum and average-position tables.

    Each table carries the match's day and teams; fields that the payload's schema lacks are null.
    """
    head = matches.withColumns({name: at(matches, path, kind) for name, path, kind in MATCH_FIELDS if name in SIDE_FIELDS}).withColumn("match_date", F.substring("match_date", 1, 10))

    def items(column: str, side: str | None = None) -> DataFrame:
        rows = head.select("match_id", *SIDE_FIELDS, *([F.lit(side).alias("side")] if side else []), F.explode_outer(column).alias("i"))
        return rows.where("i IS NOT NULL")

    def fields(rows: DataFrame, wanted, *more: str) -> DataFrame:
        return rows.select("match_id", *SIDE_FIELDS, *more, *[at(rows, f"i.{path}", kind).alias(name) for name, path, kind in wanted])

    places = [fields(items(f"positions.{side}", side), PLACE_FIELDS, "side") for side in ("home", "away")]
    return {
        "match": head.select("match_id", *SIDE_FIELDS, *[at(matches, path, kind).alias(name) for name, path, kind in MATCH_FIELDS if name not in SIDE_FIELDS]),
        "shots": fields(items("shots"), SHOT_FIELDS),
        "momentum": fields(items("momentum"), (("minute", "minute", "int"), ("value", "value", "double"))),
        "positions": places[0].unionByName(places[1]),
    }


def flatten_player_stats(df: DataFrame, stats: Sequence[str], *, payload: str = "payload", stat_schema: str = "double") -> DataFrame:
    """JSON text per player and match to one flat row; the ISO date is cut to its day."""
    fields = ", ".join(f"{s}: {stat_schema}" for s in stats)
    schema = f"player struct<id: bigint, name: string>, event struct<id: bigint, date: string>, stats struct<{fields}>"
    parsed = df.select(F.from_json(payload, schema).alias("j"))
    return parsed.select(
        F.col("j.player.id").alias("player_id"), F.col("j.player.name").alias("player_name"), F.col("j.event.id").alias("event_id"),
        F.substring("j.event.date", 1, 10).alias("event_date"), *[F.col(f"j.stats.{s}").alias(s) for s in stats],
    )


def flatten_standings(df: DataFrame) -> DataFrame:
    """A10: league, standings[][] to one row per team with home and away splits."""
    rows = df.select("league_id", F.explode(F.flatten("standings")).alias("r"))
    splits = [F.col(f"r.{part}.{k}").alias(f"{part}_{k}") for part in ("all", "home", "away") for k in ("played", "win", "draw", "lose")]
    return rows.select("league_id", F.col("r.rank").alias("rank"), F.col("r.team.id").alias("team_id"), F.col("r.team.name").alias("team_name"), F.col("r.points").alias("points"), *splits)


def flatten_fixtures(df: DataFrame, *, zone: str, provider: str = "events") -> DataFrame:
    """events[] to scheduled fixtures with UTC kickoff, edition and stable id."""
    from matchgrain.functions import scalars as S

    e = df.select("league", F.explode("events").alias("e"))
    side = lambda s: F.get(F.filter("e.competitors", lambda c: c["homeAway"] == s), F.lit(0))["name"]
    rows = e.select("league", F.col("e.id").alias("event_id"), F.col("e.status").alias("status"), F.col("e.local_time").alias("local_time"), side("home").alias("home_name"), side("away").alias("away_name"))
    open_rows = rows.where(~F.lower("status").isin("completed", "final", "post") & F.col("home_name").isNotNull() & F.col("away_name").isNotNull())
    kick = F.to_utc_timestamp(F.try_to_timestamp("local_time", F.lit("yyyy-MM-dd HH:mm")), zone)
    out = open_rows.withColumn("kickoff_utc", kick).withColumn("edition_id", F.concat_ws(":", "league", S.season_id(F.col("kickoff_utc"), zone)))
    return out.select(S.stable_fixture_id("edition_id", F.lit(provider), "event_id").alias("fixture_id"), "event_id", "edition_id", "kickoff_utc", "home_name", "away_name",
                      S.normalize_name("home_name").alias("home_key"), S.normalize_name("away_name").alias("away_key"))


def flatten_injuries(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """response[] to player / team / reason rows, team alias applied."""
    from matchgrain.functions.scalars import normalize_team_name

    rows = df.select(F.explode("response").alias("i")).select(
        F.col("i.player.name").alias("Player"), F.col("i.team.name").alias("Team"), F.col("i.player.reason").alias("Reason"), F.col("i.fixture.date").alias("Date")
    )
    return normalize_team_name(rows, "Team", aliases)


def normalize_odds(df: DataFrame, provider: str) -> DataFrame:
    """markets[].outcomes[] to one row per price; a price of 1 or less fails the job."""
    m = df.select("fixture_id", F.explode("markets").alias("m"))
    o = m.select("fixture_id", F.col("m.name").alias("market"), F.explode("m.outcomes").alias("o"))
    rows = o.select("fixture_id", F.lit(provider).alias("provider"), "market", F.col("o.name").alias("selection"), F.col("o.price").cast("double").alias("decimal_price"))
    return guard(rows, F.col("decimal_price") > 1, "decimal odds must exceed one")


def goal_difference_to_1x2(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wide goal-difference probability columns to H / D / A sums, rounded to 4.

    Columns whose names are not whole numbers are skipped. One row stays one row, so the
    sums are column arithmetic and nothing is shuffled.
    """
    def sign(c: str) -> int | None:
        try:
            return int(c.replace("GD", "").replace("=", "").strip())
        except ValueError:
            return None

    parts = {"H": F.lit(0.0), "D": F.lit(0.0), "A": F.lit(0.0)}
    for c in df.columns:
        g = None if c in keys else sign(c)
        if g is not None:
            label = "H" if g > 0 else "D" if g == 0 else "A"
            parts[label] = parts[label] + F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0))
    return df.select(*keys, *[F.round(v, 4).alias(f"p_{n}") for n, v in parts.items()])


# Output columns and the names under which providers give them.
REFEREE_FIELDS = {
    "Date": ("date", "kickoff", "matchDate"), "HomeTeam": ("homeTeam", "home", "home_team"), "AwayTeam": ("awayTeam", "away", "away_team"),
    "Referee": ("referee", "matchOfficial", "official"), "AssistantReferee1": ("assistantReferee1",),
    "AssistantReferee2": ("assistantReferee2",), "FourthOfficial": ("fourthOfficial",), "VAR": ("var", "videoAssistantReferee"),
    "AVAR": ("avar", "assistantVideoAssistantReferee"),
}


def extract_official_records(df: DataFrame, column: str = "payload") -> DataFrame:
    """Match objects under `matches`, `fixtures` or `events` at any depth.

    JSON is parsed to VARIANT. Each pass opens one level of all payloads, until a level holds nothing;
    arrays under the three names give the candidate objects. Rows with both teams and a referee are kept.
    """
    spark = df.sparkSession
    level = cut_lineage(df.select(F.try_parse_json(column).cast("string").alias("j")).where("j IS NOT NULL"))
    view = "_matchgrain_level"
    found = None
    while found is None or not level.isEmpty():
        level.select(F.try_parse_json("j").alias("v")).createOrReplaceTempView(view)
        children = spark.sql(f"SELECT e.key AS k, e.value AS v FROM {view} l, LATERAL variant_explode_outer(l.v) e WHERE e.value IS NOT NULL")
        children.where(F.lower("k").isin("matches", "fixtures", "events")).createOrReplaceTempView(view + "_hit")
        objects = spark.sql(f"SELECT e.value AS v FROM {view}_hit l, LATERAL variant_explode(l.v) e")
        found = objects if found is None else found.unionAll(objects)
        nested = children.select(F.to_json("v").alias("j")).where("j LIKE '{%' OR j LIKE '[%'")
        level = cut_lineage(nested)
    text = lambda names: F.coalesce(*[F.try_variant_get("v", f"$.{n}", "string") for n in names])
    rows = found.select(*[text(n).alias(f) for f, n in REFEREE_FIELDS.items()])
    return rows.where("HomeTeam IS NOT NULL AND AwayTeam IS NOT NULL AND Referee IS NOT NULL")


def at(df: DataFrame, path: str, kind: str = "string") -> Column:
    """A nested field as `kind`; null where the table's schema lacks any part of the path."""
    level: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(level, T.StructType) or part not in level.fieldNames():
            return F.lit(None).cast(kind)
        level = level[part].dataType
    return F.col(path).cast(kind)


# Output column, place in the provider's statistics object, kind.
PLAYER_STATISTICS = (
    ("team_name", "team.name", "string"), ("position", "games.position", "string"), ("appearances", "games.appearences", "bigint"),
    ("minutes", "games.minutes", "bigint"), ("rating", "games.rating", "double"), ("goals", "goals.total", "bigint"), ("assists", "goals.assists", "bigint"),
    ("shots", "shots.total", "bigint"), ("shots_on_target", "shots.on", "bigint"), ("key_passes", "passes.key", "bigint"), ("pass_accuracy", "passes.accuracy", "double"),
    ("tackles", "tackles.total", "bigint"), ("dribbles", "dribbles.success", "bigint"), ("yellow_cards", "cards.yellow", "bigint"), ("red_cards", "cards.red", "bigint"),
)


def flatten_top_players(lists: dict[str, DataFrame], teams: Column | None = None) -> DataFrame:
    """Player, statistics[] to one row per player and team, with the list's tag.

    `teams` maps `team_name` to the name used elsewhere (column `team`); without it both are equal. Fields that a
    payload's schema lacks are null.
    """
    out = None
    for tag, df in lists.items():
        rows = df.select("player", F.explode_outer("statistics").alias("s"))
        rows = rows.select(
            at(rows, "player.id", "bigint").alias("player_id"), at(rows, "player.name").alias("player_name"), at(rows, "player.age", "int").alias("age"),
            at(rows, "player.nationality").alias("nationality"), *[at(rows, f"s.{path}", kind).alias(name) for name, path, kind in PLAYER_STATISTICS], F.lit(tag).alias("category"),
        )
        rows = rows.withColumn("team", F.col("team_name") if teams is None else teams)
        out = rows if out is None else out.unionByName(rows)
    return out


# Minute ranges of goals for a team.
MINUTE_BUCKETS = ("0-15", "16-30", "31-45", "46-60", "61-75", "76-90", "91-105")
# Counters of a team's season (0 where missing) and texts ('' where missing), with their places.
TEAM_COUNTERS = (
    ("played", "fixtures.played.total"), ("wins", "fixtures.wins.total"), ("draws", "fixtures.draws.total"), ("losses", "fixtures.loses.total"),
    ("home_wins", "fixtures.wins.home"), ("away_wins", "fixtures.wins.away"), ("goals_for", "goals.for.total.total"), ("goals_against", "goals.against.total.total"),
    ("goals_for_avg_home", "goals.for.average.home"), ("goals_for_avg_away", "goals.for.average.away"), ("goals_against_avg_home", "goals.against.average.home"),
    ("goals_against_avg_away", "goals.against.average.away"), ("clean_sheets_home", "clean_sheet.home"), ("clean_sheets_away", "clean_sheet.away"),
    ("clean_sheets", "clean_sheet.total"), ("failed_to_score_home", "failed_to_score.home"), ("failed_to_score_away", "failed_to_score.away"),
    ("penalties_scored", "penalty.scored.total"), ("penalties_missed", "penalty.missed.total"), ("longest_wins", "biggest.streak.wins"),
    ("longest_draws", "biggest.streak.draws"), ("longest_losses", "biggest.streak.loses"),
)
TEAM_TEXTS = (
    ("form", "form"), ("biggest_win_home", "biggest.wins.home"), ("biggest_win_away", "biggest.wins.away"), ("biggest_loss_home", "biggest.loses.home"),
)


def flatten_team_statistics(df: DataFrame) -> DataFrame:
    """Season statistics (column `stats`) to one flat row.

    Missing counters are 0 and missing texts empty; goals per range of minutes (maps from range to a struct with `total`) stay null where missing.
    The formation is that of the first line-up.
    """
    kind = lambda name: "double" if "_avg_" in name else "bigint"
    counters = [F.coalesce(at(df, f"stats.{path}", kind(name)), F.lit(0).cast(kind(name))).alias(name) for name, path in TEAM_COUNTERS]
    texts = [F.coalesce(at(df, f"stats.{path}"), F.lit("")).alias(name) for name, path in TEAM_TEXTS]

    def minute(side: str, b: str) -> Column:
        value = at(df, f"stats.goals.{side}.minute", "map<string,struct<total:bigint>>")
        return F.try_element_at(value, F.lit(b))["total"].alias(f"goals_{'against_' if side == 'against' else ''}{b.replace('-', '_')}")

    return df.select(
        "team_id", *texts[:1], *counters, *texts[1:], *[minute("for", b) for b in MINUTE_BUCKETS], minute("against", "76-90"),
        F.coalesce(F.try_element_at("stats.lineups", F.lit(1))["formation"], F.lit("")).alias("formation"),
    )


def flatten_coaches(df: DataFrame) -> DataFrame:
    """Name, age and nationality of a team's coach, start of the open career entry, number of clubs."""
    open_entry = F.get(F.filter("career", lambda c: c["end"].isNull()), F.lit(0))
    return df.select(
        "team_id", at(df, "coach_id", "bigint").alias("coach_id"), "coach_name", at(df, "age", "int").alias("age"), at(df, "nationality").alias("nationality"),
        F.coalesce(open_entry["start"], F.lit("")).alias("start_date"), F.size("career").alias("clubs"),
    )


def flatten_squads(df: DataFrame) -> DataFrame:
    """Squad players."""
    p = df.select("team_id", F.explode("players").alias("p"))
    fields = (("player_id", "id", "bigint"), ("player_name", "name", "string"), ("age", "age", "int"), ("number", "number", "int"), ("position", "position", "string"))
    return p.select("team_id", *[at(p, f"p.{path}", kind).alias(name) for name, path, kind in fields])


def flatten_transfers(df: DataFrame, season_start: Column) -> DataFrame:
    """transfers[] on or after the season start; a date that cannot be read drops the row, as it has no season."""
    t = df.select("player_id", at(df, "player_name").alias("player_name"), F.explode("transfers").alias("t"))
    nested = isinstance(t.select("t.teams.in").schema[0].dataType, T.StructType)
    team = lambda side: F.coalesce(at(t, f"t.teams.{side}.name" if nested else f"t.teams.{side}"), F.lit(""))
    rows = t.select(
        "player_id", "player_name", F.try_to_timestamp("t.date", F.lit("yyyy-MM-dd")).cast("date").alias("transfer_date"), F.col("t.type").alias("type"),
        team("in").alias("team_in"), team("out").alias("team_out"),
    )
    return rows.where(F.col("transfer_date") >= season_start)


def flatten_predictions(df: DataFrame) -> DataFrame:
    """Winner, advice, goals, totals, percentages and comparisons in a flat row, with the number of past meetings."""
    pct = lambda c: F.regexp_replace(at(df, c), "%", "").try_cast("double")
    fields = (
        ("winner_id", "winner.id", "bigint"), ("winner_name", "winner.name", "string"), ("win_or_draw", "win_or_draw", "boolean"), ("under_over", "under_over", "string"),
        ("goals_home", "goals.home", "string"), ("goals_away", "goals.away", "string"), ("advice", "advice", "string"),
    )
    return df.select(
        "fixture_id", *[at(df, f"predictions.{path}", kind).alias(name) for name, path, kind in fields],
        *[pct(f"predictions.percent.{s}").alias(f"pct_{s}") for s in ("home", "draw", "away")],
        *[pct(f"comparison.{m}.{s}").alias(f"{m}_{s}") for m in ("form", "att", "def") for s in ("home", "away")], F.size("h2h").alias("past_meetings"),
    )


def flatten_prematch_odds(df: DataFrame) -> DataFrame:
    """bookmakers[].bets[].values[] to one row per price."""
    b = df.select("fixture_id", F.explode("bookmakers").alias("b"))
    t = b.select("fixture_id", F.col("b.name").alias("bookmaker"), F.explode("b.bets").alias("t"))
    v = t.select("fixture_id", "bookmaker", F.col("t.name").alias("market"), F.explode("t.values").alias("v"))
    return v.select("fixture_id", "bookmaker", "market", F.col("v.value").alias("selection"), F.col("v.odd").try_cast("double").alias("decimal_price"))
