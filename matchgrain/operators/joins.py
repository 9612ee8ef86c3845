"""Point-in-time and enrichment joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.functions import scalars as S
from matchgrain.functions.contracts import guard, require, seconds
from matchgrain.functions.storage import cut_lineage
from matchgrain.operators import grids
from matchgrain.operators.ordered import asof_prior, prior_totals, time_bucket

# --- entities ---------------------------------------------------------------------


def resolve_entities(rows: DataFrame, aliases: DataFrame, canonical: DataFrame, *, provider="provider", name="raw_name", on="on_date", output="team_id") -> DataFrame:
    """Alias valid on the day (bounds included), else canonical name, else unresolved.

    Every distinct (provider, name, day) is resolved once; two valid aliases are an error.
    aliases: provider, external_name, team_id, valid_from, valid_to; canonical: canonical_name, team_id.
    """
    keyed = rows.withColumn("_p", F.lower(provider)).withColumn("_k", S.normalize_name(name)).withColumn("_d", F.col(on).cast("date"))
    wanted = keyed.select("_p", "_k", "_d").distinct()
    known = aliases.select(
        F.lower("provider").alias("_p2"), S.normalize_name("external_name").alias("_k2"),
        F.col("valid_from").cast("date").alias("_f"), F.col("valid_to").cast("date").alias("_t"), F.col("team_id").alias("_id"),
    )
    valid = (F.col("_f").isNull() | (F.col("_f") <= F.col("_d"))) & (F.col("_t").isNull() | (F.col("_d") <= F.col("_t")))
    hits = (
        wanted.join(known, (F.col("_p") == F.col("_p2")) & (F.col("_k") == F.col("_k2")) & valid)
        .groupBy("_p", "_k", "_d")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_alias"))
    )
    hits = guard(hits, F.col("_n") == 1, "a provider name has two teams on one day").drop("_n")
    names = canonical.groupBy(S.normalize_name("canonical_name").alias("_k")).agg(
        F.count_distinct("team_id").alias("_n"), F.max("team_id").alias("_canon")
    )
    names = guard(names, F.col("_n") == 1, "two teams share one canonical name").drop("_n")
    joined = keyed.join(hits, ["_p", "_k", "_d"], "left").join(names, "_k", "left")
    status = (
        F.when(F.col("_alias").isNotNull(), "provider_alias").when(F.col("_canon").isNotNull(), "exact_canonical").otherwise("unresolved")
    )
    return joined.withColumn(output, F.coalesce("_alias", "_canon")).withColumn(f"{output}_status", status).drop(
        "_p", "_k", "_d", "_alias", "_canon"
    )


def unresolved_names(resolved: DataFrame, name="raw_name", team="team_id") -> DataFrame:
    """Distinct names without a team."""
    return resolved.where(F.col(team).isNull()).select(name).distinct()


def with_new_team_fallback(resolved: DataFrame, approved: DataFrame, name="raw_name", team="team_id") -> DataFrame:
    """Approved new teams (raw_name, approved_team_id) fill unresolved rows, marked as priors."""
    joined = resolved.join(approved.withColumnRenamed("raw_name", name), name, "left")
    use = F.col(team).isNull() & F.col("approved_team_id").isNotNull()
    return joined.withColumn(f"{team}_status", F.when(use, "new_team_prior").otherwise(F.col(f"{team}_status"))).withColumn(
        team, F.coalesce(team, "approved_team_id")
    ).drop("approved_team_id")


def normalize_fixtures(source: DataFrame, aliases: DataFrame, canonical: DataFrame, *, edition: Column, provider: str, zone: str, rules_version: str = "1") -> DataFrame:
    """Provider rows (event_id, home_name, away_name, local_date, local_time) to canonical fixtures."""
    require(source, ("event_id", "home_name", "away_name", "local_date", "local_time"), "provider columns")
    rows = source.withColumn("provider", F.lit(provider)).withColumn(
        "kickoff_utc", S.kickoff_utc("local_date", "local_time", zone)
    ).withColumn("edition_id", edition)
    for side in ("home", "away"):
        rows = resolve_entities(rows, aliases, canonical, name=f"{side}_name", on="local_date", output=f"{side}_team_id")
    observed = F.col("observed_at") if "observed_at" in source.columns else F.col("kickoff_utc") - F.expr("INTERVAL 1 DAY")
    return rows.select(
        S.stable_fixture_id("edition_id", F.lit(provider), "event_id").alias("fixture_id"),
        "edition_id", F.lit(rules_version).alias("rules_version"), "kickoff_utc", "home_team_id", "away_team_id",
        F.col("event_id").cast("string").alias("provider_event_id"), F.lit(provider).alias("source"),
        observed.alias("observed_at"), "home_team_id_status", "away_team_id_status",
    )


def unique_by(df: DataFrame, keys: Sequence[str], newest: Column) -> DataFrame:
    """One row per key, the newest (partial aggregation, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_r"))
    return picked.select(*keys, "_r.*")


def enrich_match_xg(history: DataFrame, xg: DataFrame, keys=("HomeTeam", "AwayTeam", "MatchDate")) -> DataFrame:
    """C4: left join of the xG source, one row per key (the largest pair when it repeats)."""
    one = unique_by(xg.select(*keys, "home_xg", "away_xg"), keys, F.struct("home_xg", "away_xg"))
    return history.join(one, list(keys), "left")


# --- as-of over validity intervals ------------------------------------------------


def asof_valid(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    at: str = "kickoff_utc",
    ids: Sequence[str] = ("fixture_id",),
    take: Mapping[str, str],
    tie: Sequence[str] = (),
    bucket_days: int | None = 90,
    how: str = "left",
) -> DataFrame:
    """Latest snapshot observed strictly before `at` and valid in [from, to).

    An interval is copied to each time bucket it touches and joined on (keys, bucket), so a
    hot key is spread over the calendar and only rows that overlap in time meet. With
    `bucket_days=None` the join is on the keys alone, for keys that identify a left row.
    Latest is by (observed_at, effective_from, tie); unmatched left rows stay.
    """
    snapshots = right
    if "observed_at" not in right.columns:
        snapshots = snapshots.withColumn("observed_at", F.col("effective_from"))
    if "effective_from" not in right.columns:
        snapshots = snapshots.withColumn("effective_from", F.col("observed_at"))
    if "effective_to" not in right.columns:
        snapshots = snapshots.withColumn("effective_to", F.lit(None).cast(dict(snapshots.dtypes)["effective_from"]))
    snapshots = snapshots.where(F.col("observed_at").isNotNull() & F.col("effective_from").isNotNull())
    narrow = snapshots.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("observed_at").alias("_o"), F.col("effective_from").alias("_f"), F.col("effective_to").alias("_t"),
        F.struct(*[F.col(c) for c in tie]).alias("_tie") if tie else F.lit(0).alias("_tie"),
        F.struct(*[F.col(c).alias(o) for c, o in take.items()]).alias("_v"),
    )
    targets = left.select(*ids, at, *[k for k in keys if k not in ids])
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    if bucket_days is not None:
        width = bucket_days * 86400
        horizon = left.agg(F.max(time_bucket(at, width)).alias("h")).scalar()
        first = time_bucket(F.greatest("_o", "_f"), width)
        last = F.least(F.coalesce(time_bucket("_t", width), horizon), horizon)
        narrow = narrow.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
        narrow = narrow.withColumn("_b", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
        targets = targets.withColumn("_at_b", time_bucket(at, width))
        on.append(F.col("_b") == F.col("_at_b"))
    valid = (F.col("_o") < F.col(at)) & (F.col("_f") <= F.col(at)) & (F.col("_t").isNull() | (F.col(at) < F.col("_t")))
    condition = valid
    for part in on:
        condition = condition & part
    best = (
        targets.join(narrow, condition)
        .groupBy(*ids)
        .agg(F.max_by("_v", F.struct("_o", "_f", "_tie")).alias("_best"))
    )
    return left.join(best, list(ids), how).select(*left.columns, *[F.col(f"_best.{o}").alias(o) for o in take.values()])


def manager_at_kickoff(matches: DataFrame, tenures: DataFrame) -> DataFrame:
    """Manager of both sides; both sides are one as-of join over two rows per match."""
    require(tenures, ("team_id", "manager_id", "effective_from"), "manager-tenure columns")
    sides = matches.select(
        "fixture_id", "kickoff_utc",
        F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_team_id").alias("team_id")) for s in ("home", "away")])),
    )
    found = asof_valid(sides, tenures, ["team_id"], ids=["fixture_id", "side"], take={"manager_id": "manager_id"}, tie=["manager_id"])
    return found.groupBy("fixture_id").agg(
        *[F.max(F.when(F.col("side") == s, F.col("manager_id"))).alias(f"{s}_manager_id") for s in ("home", "away")]
    )


def referee_at_kickoff(fixtures: DataFrame, assignments: DataFrame) -> DataFrame:
    """Key is the fixture, `effective_from` defaults to the observation."""
    require(assignments, ("fixture_id", "referee_id", "observed_at"), "referee-assignment columns")
    return asof_valid(
        fixtures.select("fixture_id", "kickoff_utc"), assignments, ["fixture_id"],
        take={"referee_id": "referee_id", "observed_at": "observed_at"}, tie=["referee_id"], bucket_days=None,
    )


def availability_at_kickoff(availability: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Latest valid row per (fixture, player); players without one are left out."""
    require(availability, ("fixture_id", "player_id", "team_id", "availability_probability", "observed_at"), "availability columns")
    players = availability.select("fixture_id", "player_id").distinct().join(fixtures.select("fixture_id", "kickoff_utc"), "fixture_id")
    return asof_valid(
        players, availability, ["fixture_id", "player_id"], ids=["fixture_id", "player_id"],
        take={c: c for c in ("team_id", "availability_probability", "observed_at")}, tie=["availability_probability"],
        bucket_days=None, how="inner",
    )


def latest_quotes_before(quotes: DataFrame, issues: DataFrame | None = None, issued_at: Column | None = None) -> DataFrame:
    """Latest quote per (fixture, market, selection, book) strictly before the issue time.

    Pass one time for all, or a table (fixture_id, issued_at). Equal times: highest price.
    """
    keys = ("fixture_id", "market", "selection", "bookmaker")
    if issues is not None:
        seen = quotes.join(issues.select("fixture_id", "issued_at"), "fixture_id").where(
            F.col("observed_at") < F.col("issued_at")
        ).drop("issued_at")
    else:
        seen = quotes.where(F.col("observed_at") < issued_at)
    return unique_by(seen, keys, F.struct("observed_at", "decimal_price"))


def rating_as_of(targets: DataFrame, ratings: DataFrame, *, cutoff="kickoff_utc", prior: Column | None = None) -> DataFrame:
    """C11: latest rating (team_id, observed_at, rating) strictly before the cutoff, else prior, else 1500."""
    found = asof_prior(
        targets, ratings, ["team_id"], left_time=cutoff, right_time="observed_at", values={"rating": "_rating"}, right_tie=["rating"]
    )
    default = F.lit(1500.0) if prior is None else F.coalesce(prior, F.lit(1500.0))
    return found.withColumn("rating", F.coalesce("_rating", default)).drop("_rating")


def fixture_difficulty(fixtures: DataFrame, ratings: DataFrame) -> DataFrame:
    """Opponent rating (1500 when missing) with a 55-point venue effect, ranked within the team."""
    from matchgrain.operators.ranks import with_ranks

    r = ratings.select("fixture_id", F.col("team_id").alias("opponent_id"), F.col("pre_match_rating").alias("opponent_rating"), F.col("observed_at").alias("rating_observed_at"))
    joined = fixtures.join(r, ["fixture_id", "opponent_id"], "left")
    joined = guard(
        joined, F.col("rating_observed_at").isNull() | (F.col("rating_observed_at") < F.col("kickoff_utc")),
        "Fixture difficulty contains a post-kickoff rating",
    )
    venue = F.when(F.col("venue_role") == "home", -55.0).when(F.col("venue_role") == "away", 55.0).otherwise(0.0)
    joined = joined.withColumn("opponent_rating", F.coalesce("opponent_rating", F.lit(1500.0))).withColumn(
        "difficulty_rating", F.col("opponent_rating") + venue
    )
    return with_ranks(joined, {"difficulty_percentile": "difficulty_rating"}, group=["team_id"], pct=True)


def opponent_adjusted_points(events: DataFrame, ratings: DataFrame) -> DataFrame:
    """C13."""
    r = ratings.select("fixture_id", F.col("team_id").alias("opponent_id"), F.col("pre_match_rating").alias("opponent_rating"))
    joined = events.join(r, ["fixture_id", "opponent_id"], "left")
    expected = F.lit(3.0) / (1 + F.pow(F.lit(10.0), -(F.coalesce("opponent_rating", F.lit(1500.0)) - 1500.0) / 400.0))
    return joined.withColumn("opponent_adjusted_points", F.col("points") - expected)


def upcoming_feature_matrix(
    history: DataFrame,
    upcoming: DataFrame,
    features: Sequence[str],
    *,
    means: Mapping[str, float],
    state_sources: Mapping[str, Mapping[str, str]],
    time: str = "kickoff_utc",
    assemble: bool = False,
) -> DataFrame:
    """C14: given value, else the team's latest state before kickoff, else the training mean.

    `state_sources[feature]` names the fixture role and the history columns for a team that
    was at home or away. With `assemble` a `features` vector in contract order is added.
    """
    mapped = [f for f in features if f in state_sources]

    def state(feature: str, role: str) -> Column:
        return F.struct(
            F.col(f"{role}_team_id").alias("team_id"), F.lit(feature).alias("feature"), F.lit(int(role == "away")).alias("role"),
            F.col(state_sources[feature][f"{role}_history_column"]).cast("double").alias("value"),
        )

    out = upcoming
    if mapped:
        long = history.select(
            F.col(time).alias("observed_at"), "fixture_id", F.inline(F.array(*[state(f, r) for f in mapped for r in ("home", "away")]))
        ).where(F.col("value").isNotNull())
        wanted = upcoming.select(
            F.col("fixture_id").alias("target_id"), F.col(time).alias("cutoff"),
            F.inline(F.array(*[
                F.struct(F.col(f"{state_sources[f]['fixture_role']}_team_id").alias("team_id"), F.lit(f).alias("feature")) for f in mapped
            ])),
        )
        found = asof_prior(
            wanted, long, ["team_id", "feature"], left_time="cutoff", right_time="observed_at",
            values={"value": "state"}, right_tie=["role", "fixture_id"],
        )
        wide = found.groupBy(F.col("target_id").alias("fixture_id")).agg(
            *[F.max(F.when(F.col("feature") == f, F.col("state"))).alias(f"_s_{f}") for f in mapped]
        )
        out = upcoming.join(wide, "fixture_id", "left")
    columns = []
    for f in features:
        options = [F.col(f).cast("double")] if f in upcoming.columns else []
        if f in mapped:
            options.append(F.col(f"_s_{f}"))
        value = F.coalesce(*options) if options else F.lit(None).cast("double")
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
        columns.append(F.when(finite, value).otherwise(F.lit(float(means[f]))).alias(f))
    matrix = out.select("fixture_id", *columns)
    if not assemble:
        return matrix
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(matrix)


#: Half-lives of a span of C15: its weights and those of the span before stay within the range of doubles.
SPAN = 300


def action_features_at_kickoff(summaries: DataFrame, fixtures: DataFrame, *, half_life_days: float = 90.0) -> DataFrame:
    """Decayed action value per action of a team over its earlier fixtures.

    The decay since the last event cancels in the ratio, so a kickoff takes the ratio that held right after
    the latest event before it. The ratio after an event is two running sums of weights 2^(t / half-life), with t
    counted from the start of a span of SPAN half-lives, so no weight overflows; the events of the span before come along,
    and older ones weigh less than 2^-SPAN. Summaries must be observed at or after their own kickoff
    (see `action_summary`), which keeps a fixture out of its own history.
    """
    if half_life_days <= 0:
        raise ValueError(f"a half-life is a positive number of days, not {half_life_days}")
    own = fixtures.select("fixture_id", F.col("kickoff_utc").alias("_own"))
    checked = guard(
        summaries.join(own, "fixture_id", "left"), F.col("_own").isNull() | (F.col("observed_at") >= F.col("_own")),
        "an action summary was observed before its fixture began",
    ).drop("_own")
    order = ["_t", "_k", "_f"]
    past = checked.select(
        "team_id", F.col("observed_at").alias("_t"), F.lit(1).alias("_k"), F.col("fixture_id").alias("_f"),
        F.col("action_value").cast("double").alias("_v"), F.col("actions").cast("double").alias("_n"),
    )
    age = seconds("_t") / (86400.0 * half_life_days)
    home = F.floor(age / SPAN).cast("bigint")
    spans = past.withColumn("_home", home).withColumn("_span", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    w = F.pow(F.lit(2.0), age - F.col("_span") * float(SPAN))
    weighed = spans.withColumns({"_wv": w * F.col("_v"), "_wn": w * F.col("_n")})
    after = prior_totals(cut_lineage(weighed), ["team_id", "_span"], order, time_bucket("_t"), sums={"_sv": F.col("_wv"), "_sn": F.col("_wn")}).where("_span = _home")
    top, bottom = F.col("_sv") + F.coalesce("_wv", F.lit(0.0)), F.col("_sn") + F.coalesce("_wn", F.lit(0.0))
    states = after.select("team_id", *order, "_n", F.when(bottom > 0, top / bottom).alias("_ratio"))
    targets = fixtures.select(
        "fixture_id", F.col("kickoff_utc").alias("_t"), F.lit(0).alias("_k"), F.col("fixture_id").alias("_f"),
        F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_team_id").alias("team_id")) for s in ("home", "away")])),
    )
    walked = prior_totals(
        cut_lineage(states.unionByName(targets, allowMissingColumns=True)), ["team_id"], order, time_bucket("_t"),
        sums={"_an": F.col("_n")}, maxes={"feature_timestamp": F.when(F.col("_k") == 1, F.col("_t"))}, lasts={"_last": F.col("_ratio")},
    ).where("_k = 0")
    return walked.select(
        "fixture_id", "team_id", "side", F.col("_last").alias("lagged_action_value_per_action"),
        F.col("_an").cast("bigint").alias("history_actions"), "feature_timestamp",
    )


def manager_by_date(rows: DataFrame, ranges: DataFrame, current: DataFrame, *, team="team_id", on="match_date") -> DataFrame:
    """First range (by ordinal) that holds the day, bounds included; else the current manager.

    ranges: team_id, start_date, end_date, manager, ordinal; current: team_id, manager.
    """
    wanted = rows.select(F.col(team).alias("_team"), F.col(on).alias("_day")).distinct()
    r = ranges.select(F.col("team_id").alias("_team2"), "start_date", "end_date", F.col("manager").alias("_m"), "ordinal")
    inside = (F.col("_team") == F.col("_team2")) & F.col("_day").between(F.col("start_date"), F.col("end_date"))
    hits = wanted.join(r, inside).groupBy("_team", "_day").agg(F.min_by("_m", "ordinal").alias("_hit"))
    now = current.select(F.col("team_id").alias("_team3"), F.col("manager").alias("_now"))
    return (
        rows.join(hits, (F.col(team) == F.col("_team")) & (F.col(on) == F.col("_day")), "left")
        .join(now, F.col(team) == F.col("_team3"), "left")
        .withColumn("manager", F.coalesce("_hit", "_now"))
        .drop("_team", "_day", "_hit", "_team3", "_now")
    )


WEATHER_DEFAULTS = {"Precipitation": 0.0, "WeatherDescription": "Unknown"}


def weather_enrichment(matches: DataFrame, readings: DataFrame, *, team="home_team_id", day="match_date", newest="fetched_at", defaults: Mapping = WEATHER_DEFAULTS) -> DataFrame:
    """C17: newest reading per `team_date`, left joined, with typed defaults."""
    latest = unique_by(readings, ["cache_key"], F.col(newest)).drop(newest)
    key = F.concat_ws("_", F.col(team).cast("string"), F.date_format(day, "yyyy-MM-dd"))
    joined = matches.withColumn("cache_key", key).join(latest, "cache_key", "left").drop("cache_key")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in joined.columns})


def side_counts(matches: DataFrame, counted: DataFrame, *, team: str, names: tuple[str, str, str], advantage: str, count: Column | None = None) -> DataFrame:
    """A count per team joined to both sides; missing is 0."""
    totals = counted.groupBy(team).agg((count if count is not None else F.count(F.lit(1))).alias("_n"))
    out = matches
    for side, name in zip(("home", "away"), names):
        out = out.join(totals.select(F.col(team).alias(f"{side}_team_id"), F.col("_n").alias(name)), f"{side}_team_id", "left").withColumn(
            name, F.coalesce(name, F.lit(0))
        )
    gap = F.col(names[1]) - F.col(names[0]) if advantage == "away" else F.col(names[0]) - F.col(names[1])
    return out.withColumn(names[2], gap)


def injury_features(matches: DataFrame, injuries: DataFrame) -> DataFrame:
    """Injuries per side, advantage = away - home."""
    return side_counts(matches, injuries, team="team_id", names=("HomeInjuryCount", "AwayInjuryCount", "InjuryAdvantage"), advantage="away")


def squad_size_features(matches: DataFrame, players: DataFrame) -> DataFrame:
    """Squad size per side, advantage = home - away."""
    return side_counts(
        matches, players, team="team_id", names=("HomeSquadSize", "AwaySquadSize", "SquadSizeAdvantage"), advantage="home",
        count=F.count_distinct("player_id"),
    )


def referee_assignment_join(frame: DataFrame, assignments: DataFrame, keys=("home_team_id", "away_team_id", "match_date")) -> DataFrame:
    """Left join on both teams and the day; `Not yet assigned` without a match."""
    if "Referee" in frame.columns:
        return frame
    one = unique_by(assignments, keys, F.struct("Referee"))
    return frame.join(one, list(keys), "left").withColumn("Referee", F.coalesce("Referee", F.lit("Not yet assigned")))


def settle_predictions(log: DataFrame, results: DataFrame, keys=("match_date", "home_team_id", "away_team_id")) -> DataFrame:
    """C20: fill actual result and correctness of unsettled predictions; ties go to the later letter."""
    one = results.groupBy(*keys).agg(F.min("result").alias("_actual"))
    pick = F.array_max(
        F.array(
            F.struct(F.col("p_home").alias("p"), F.lit("H").alias("r")),
            F.struct(F.col("p_draw").alias("p"), F.lit("D").alias("r")),
            F.struct(F.col("p_away").alias("p"), F.lit("A").alias("r")),
        )
    )["r"]
    open_row = F.col("actual_result").isNull() & F.col("_actual").isNotNull()
    return log.join(one, list(keys), "left").withColumn("correct", F.when(open_row, pick == F.col("_actual")).otherwise(F.col("correct"))).withColumn(
        "actual_result", F.coalesce("actual_result", "_actual")
    ).drop("_actual")


def best_bets(predictions: DataFrame, odds: DataFrame, keys: Sequence[str] = ("fixture_id",), *, minimum_edge=0.03, minimum_value=0.03) -> DataFrame:
    """Outcomes whose edge and expected value reach the limits.

    predictions: HomeWin_Prob, Draw_Prob, AwayWin_Prob, with legacy PredHomeWin, PredDraw,
    PredAwayWin used where the modern value is missing or 0. odds: B365H/D/A with fallback
    OddsHome/Draw/Away used where the first is missing or not above 1.
    """
    joined = predictions.join(odds, list(keys), "left")
    outcomes = (
        ("Home Win", "HomeWin_Prob", "PredHomeWin", "B365H", "OddsHome"),
        ("Draw", "Draw_Prob", "PredDraw", "B365D", "OddsDraw"),
        ("Away Win", "AwayWin_Prob", "PredAwayWin", "B365A", "OddsAway"),
    )

    def value(name: str) -> Column:
        return F.col(name).try_cast("double") if name in joined.columns else F.lit(None).cast("double")

    ps = [F.coalesce(F.nullif(value(m), F.lit(0.0)), value(old)) for _, m, old, _, _ in outcomes]
    prices = [
        F.coalesce(F.when(value(a) > 1, value(a)), F.when(value(z) > 1, value(z))) for _, _, _, a, z in outcomes
    ]
    staged = joined.select(*keys, *[p.alias(f"_p{i}") for i, p in enumerate(ps)], *[o.alias(f"_o{i}") for i, o in enumerate(prices)])
    total = F.col("_p0") + F.col("_p1") + F.col("_p2")
    overround = 1 / F.col("_o0") + 1 / F.col("_o1") + 1 / F.col("_o2")
    usable = staged.where((F.least("_p0", "_p1", "_p2") >= 0) & total.isNotNull() & (total > 0) & overround.isNotNull())
    rows = usable.select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(o[0]).alias("pick"), (F.col(f"_p{i}") / total).alias("p"), F.col(f"_o{i}").alias("price"), (1 / F.col(f"_o{i}") / overround).alias("m"))
            for i, o in enumerate(outcomes)
        ])),
    )
    ev = F.col("p") * F.col("price") - 1
    kept = rows.where((F.col("p") - F.col("m") >= minimum_edge) & (ev >= minimum_value))
    return kept.select(
        *keys, "pick", F.round("p", 4).alias("confidence"), F.round(F.col("p") - F.col("m"), 4).alias("edge"),
        F.round("m", 4).alias("market_probability"), F.round(ev, 4).alias("expected_value"),
        S.value_tier(ev).alias("tier"), S.american_odds("price").alias("odds"),
    )


def eligible_opponents(pools: DataFrame, phase: str = "split") -> DataFrame | None:
    """(edition, team, opponent) inside one pool; None when the phase is unrestricted.

    The pairs are the answer itself; pools have a fixed size set by the competition rules.
    """
    if phase == "regular":
        return None
    other = pools.select("edition_id", "pool", F.col("team_id").alias("opponent_id"))
    return pools.join(other, ["edition_id", "pool"]).where(F.col("team_id") != F.col("opponent_id"))


def coverage_match(champion: DataFrame, challenger: DataFrame, key="fixture_id", target="target") -> DataFrame:
    """Counts of fixtures missing on either side and of different targets."""
    a = champion.select(key, F.col(target).alias("_a"), F.lit(True).alias("_ina"))
    b = challenger.select(key, F.col(target).alias("_b"), F.lit(True).alias("_inb"))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("_inb").isNull()).alias("only_champion"),
        F.count_if(F.col("_ina").isNull()).alias("only_challenger"),
        F.count_if(F.col("_ina") & F.col("_inb") & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("target_mismatch"),
        F.count_if(F.col("_ina") & F.col("_inb")).alias("shared"),
    )


def context_timeline(**tables: DataFrame) -> DataFrame:
    """Context tables stacked with a source tag; absent columns are null."""
    parts = [df.withColumn("context_source", F.lit(tag)) for tag, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


STAT_COLUMNS = {
    "home_attack": (("HomeGoalsAve", "AvgHomeGoals"), 1.5),
    "home_defense": (("HomeGoalsConcededAve", "AvgHomeGoalsConceded"), 1.2),
    "away_attack": (("AwayGoalsAve", "AvgAwayGoals"), 1.3),
    "away_defense": (("AwayGoalsConcededAve", "AvgAwayGoalsConceded"), 1.1),
}


def match_poisson_lookup(matches: DataFrame, stats: DataFrame, *, league_average: float = 1.4, max_goals: int = 5) -> DataFrame:
    """Team-stat rows of both sides to rates, 1X2, modal score and goal markets.

    A missing team gives .33 / .34 / .33 and an error text.
    """
    out = matches.select("fixture_id", "home_team_id", "away_team_id")
    for side in ("home", "away"):
        cols = []
        for name, (options, default) in STAT_COLUMNS.items():
            if name.startswith(side):
                found = next((c for c in options if c in stats.columns), None)
                cols.append((F.col(found).cast("double") if found else F.lit(default)).alias(name))
        out = out.join(stats.select(F.col("team_id").alias(f"{side}_team_id"), F.lit(True).alias(f"_{side}"), *cols), f"{side}_team_id", "left")
    h, a = S.estimate_goals("home_attack", "home_defense", "away_attack", "away_defense", league_average)
    known = F.col("_home").isNotNull() & F.col("_away").isNotNull()
    staged = out.select("fixture_id", known.alias("_known"), h.alias("ExpectedHomeGoals"), a.alias("ExpectedAwayGoals"))
    grid = grids.fixed_poisson_grid(
        staged.where("_known"), home_rate="ExpectedHomeGoals", away_rate="ExpectedAwayGoals", max_goals=max_goals
    )
    probs = grids.one_x_two(grid)
    markets = grids.closed_form_goal_markets("ExpectedHomeGoals", "ExpectedAwayGoals", max_goals=max_goals)
    joined = staged.join(probs, "fixture_id", "left")
    result = {
        "HomeWinProb": F.coalesce("p_home", F.lit(0.33)), "DrawProb": F.coalesce("p_draw", F.lit(0.34)),
        "AwayWinProb": F.coalesce("p_away", F.lit(0.33)),
        "error": F.when(~F.col("_known"), "Team statistics not found"),
        **{n: F.when(F.col("_known"), c) for n, c in markets.items()},
    }
    return joined.withColumns(result).drop("p_home", "p_draw", "p_away", "_known")


def manager_advantage(matches: DataFrame, stats: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Home - away difference of manager metrics; unknown managers get the defaults."""
    out = matches
    for side in ("home", "away"):
        renamed = stats.select(
            F.col("manager_id").alias(f"{side}_manager_id"), *[F.col(m).alias(f"_{side}_{m}") for m in defaults]
        )
        out = out.join(renamed, f"{side}_manager_id", "left")
    diffs = {
        f"{m}_diff": F.coalesce(F.col(f"_home_{m}"), F.lit(d)) - F.coalesce(F.col(f"_away_{m}"), F.lit(d))
        for m, d in defaults.items()
    }
    return out.withColumns(diffs).drop(*[f"_{s}_{m}" for s in ("home", "away") for m in defaults])
