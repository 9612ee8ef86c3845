"""Quality gates as tables of check rows, profiles, publication decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.contracts import require

CHECK_SCHEMA = "check string, status string, severity string, observed bigint, expected bigint"


def _checks(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of counts to check rows: passed when the count is 0."""
    rows = [
        F.struct(
            F.lit(n).alias("check"), F.when(F.col(n) == 0, "passed").otherwise("failed").alias("status"), F.lit("blocking").alias("severity"),
            F.col(n).cast("bigint").alias("observed"), F.lit(0).cast("bigint").alias("expected"),
        )
        for n in names
    ]
    return counts.select(F.inline(F.array(*rows)))


def data_quality_summary(df: DataFrame, as_of: Column, *, date="MatchDate", key=("HomeTeam", "AwayTeam"), features: Sequence[str] = ()) -> DataFrame:
    """Rows, invalid and future dates, range, duplicate fixtures and feature vectors (all copies count)."""
    base = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(date).isNull()).alias("invalid_dates"),
        F.count_if(F.coalesce(F.col(date) > as_of, F.lit(False))).alias("future_rows"), F.min(date).alias("earliest"), F.max(date).alias("latest"),
    )

    def copies(columns) -> Column:
        per = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("c"))
        return per.where("c > 1").agg(F.coalesce(F.sum("c"), F.lit(0))).scalar()

    out = base.withColumn("duplicate_fixtures", copies([date, *key]))
    return out.withColumn("duplicate_feature_rows", copies(features) if features else F.lit(0).cast("bigint"))


def fixture_quality_gates(fixtures: DataFrame) -> DataFrame:
    """Blocking checks of the canonical fixture table; duplicates are rows beyond the first."""
    require(
        fixtures,
        ("fixture_id", "edition_id", "rules_version", "kickoff_utc", "home_team_id", "away_team_id", "provider_event_id", "source", "observed_at"),
        "canonical fixture fields",
    )
    blank = lambda c: F.coalesce(F.col(c).cast("string") == "", F.lit(True))
    n = F.count(F.lit(1))
    counts = fixtures.agg(
        (n - F.count_distinct(F.struct("fixture_id"))).alias("duplicate_fixture_ids"),
        (n - F.count_distinct(F.struct("source", "provider_event_id"))).alias("duplicate_provider_events"),
        F.count_if(F.col("home_team_id").isNull() | F.col("away_team_id").isNull()).alias("unresolved_active_teams"),
        F.count_if(F.col("kickoff_utc").isNull() | F.col("observed_at").isNull()).alias("invalid_timestamps"),
        F.count_if(F.coalesce(F.col("home_team_id") == F.col("away_team_id"), F.lit(False))).alias("self_fixtures"),
        F.count_if(blank("edition_id") | blank("rules_version")).alias("missing_edition_or_rules"),
    )
    return _checks(counts, counts.columns)


def match_value_gates(fixtures: DataFrame, odds: DataFrame | None = None, price: str = "decimal_price") -> DataFrame:
    """No negative goals, every price a finite number above one."""
    goals = [F.count_if(F.coalesce(F.col(c) < 0, F.lit(False))) for c in ("home_goals", "away_goals") if c in fixtures.columns]
    out = _checks(fixtures.agg(sum(goals[1:], goals[0]).alias("non_negative_goals")), ["non_negative_goals"])
    if odds is None:
        return out
    p = F.col(price).try_cast("double") if price in odds.columns else F.lit(None).cast("double")
    bad = p.isNull() | F.isnan(p) | (p <= 1) | (p == float("inf"))
    return out.unionByName(_checks(odds.agg(F.count_if(bad).alias("valid_decimal_odds")), ["valid_decimal_odds"]))


def point_in_time_gates(features: DataFrame, fixtures: DataFrame, *, timestamps=("feature_timestamp", "observed_at"), numeric: Sequence[str] | None = None) -> DataFrame:
    """Features covered by a fixture, observed strictly before kickoff, and finite."""
    present = [t for t in timestamps if t in features.columns]
    if not present:
        raise ValueError("No point-in-time timestamp is present on the feature table")
    if numeric is None:
        numeric = [c for c, t in features.dtypes if t in ("double", "float", "int", "bigint") and c not in ("fixture_id", "home_goals", "away_goals")]
    kick = fixtures.groupBy("fixture_id").agg(F.any_value("kickoff_utc").alias("_k"))
    joined = features.join(kick, "fixture_id", "left")
    late = {f"{t}_before_kickoff": F.count_if(F.coalesce(F.col(t) >= F.col("_k"), F.col(t).isNull())) for t in present}
    broken = F.lit(0)
    for c in numeric:
        x = F.col(c).cast("double")
        broken = broken + (x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).cast("int")
    counts = joined.agg(
        F.count_if(F.col("_k").isNull()).alias("feature_fixture_coverage"), *[c.alias(n) for n, c in late.items()], F.sum(broken).alias("finite_model_inputs")
    )
    return _checks(counts, counts.columns)


def forecast_metadata_gates(forecasts: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Issue before kickoff, a usable sample size, a cold-start status."""
    joined = forecasts.drop("kickoff_utc").join(fixtures.select("fixture_id", "kickoff_utc"), "fixture_id", "left")
    n = F.col("effective_sample_size").cast("double")
    counts = joined.agg(
        F.count_if(F.coalesce(F.col("issued_at") >= F.col("kickoff_utc"), F.lit(True))).alias("forecast_issued_before_kickoff"),
        F.count_if(n.isNull() | F.isnan(n) | (n < 0) | (n == float("inf"))).alias("forecast_effective_sample"),
        F.count_if(F.coalesce(F.col("cold_start_status") == "", F.lit(True))).alias("forecast_cold_start_status"),
    )
    return _checks(counts, counts.columns)


def forecast_coherence(fixtures: DataFrame, forecasts: DataFrame, scorelines: DataFrame) -> DataFrame:
    """Ids agree, probabilities are valid, score mass is one and matches 1X2."""
    h, a, p = F.col("home_goals"), F.col("away_goals"), F.col("probability")
    part = lambda c: F.sum(F.when(c, p).otherwise(0.0))
    mass = scorelines.groupBy("fixture_id").agg(
        F.sum(p).alias("_m"), part(h > a).alias("_h"), part(h == a).alias("_d"), part(h < a).alias("_a")
    )
    wanted = fixtures.where("status = 'scheduled'").select("fixture_id", F.lit(True).alias("_s"))
    joined = wanted.join(forecasts.select("fixture_id", "p_home", "p_draw", "p_away", F.lit(True).alias("_f")), "fixture_id", "full").join(mass, "fixture_id", "left")
    ps = [F.col(c) for c in ("p_home", "p_draw", "p_away")]
    bad = F.lit(False)
    for x in ps:
        bad = bad | x.isNull() | F.isnan(x) | (x < 0)
    gap = F.greatest(*[F.abs(x - F.col(m)) for x, m in zip(ps, ("_h", "_d", "_a"))])
    has = F.col("_f").isNotNull()
    counts = joined.agg(
        F.count_if(F.col("_s").isNull() | F.col("_f").isNull()).alias("forecast_ids"),
        F.count_if(has & bad).alias("valid_probabilities"),
        F.count_if(has & (F.abs(ps[0] + ps[1] + ps[2] - 1) > 1e-8)).alias("probabilities_sum_to_one"),
        F.count_if(F.col("_s").isNotNull() & F.coalesce(F.abs(F.col("_m") - 1) > 1e-6, F.lit(True))).alias("scoreline_mass"),
        F.count_if(has & F.coalesce(gap > 1e-6, F.lit(True))).alias("scoreline_agreement"),
    )
    return _checks(counts, counts.columns)


def publication_gate(*reports: DataFrame) -> DataFrame:
    """Publishable when there are checks and no blocking one failed; names the failures."""
    checks = reports[0]
    for r in reports[1:]:
        checks = checks.unionByName(r)
    failed = (F.col("severity") == "blocking") & (F.col("status") != "passed")
    return checks.agg(
        F.count(F.lit(1)).alias("checks"), (F.coalesce(~F.bool_or(failed), F.lit(False))).alias("publishable"),
        F.concat_ws(", ", F.sort_array(F.collect_set(F.when(failed, F.col("check"))))).alias("failures"),
    )


def feature_availability(features: DataFrame, tables: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Shipped / deferred (missing tables) / capability_unavailable (reason) per feature.

    features: feature, required (array), capability; tables: table_name; capabilities:
    capability, status, reason.
    """
    need = features.select("feature", F.explode_outer("required").alias("table_name"))
    missing = need.where("table_name IS NOT NULL").join(tables, "table_name", "left_anti").groupBy("feature").agg(
        F.array_join(F.sort_array(F.collect_set("table_name")), ", ").alias("missing")
    )
    out = features.join(missing, "feature", "left").join(capabilities.withColumnRenamed("status", "_st"), "capability", "left")
    blocked = F.col("capability").isNotNull() & ~F.coalesce(F.col("_st").isin("available", "degraded"), F.lit(False))
    status = F.when(F.col("missing").isNotNull(), "deferred").when(blocked, "capability_unavailable").otherwise("shipped")
    text = F.when(F.col("missing").isNotNull(), F.concat(F.lit("missing: "), "missing")).when(blocked, F.coalesce("reason", F.lit("capability not reported")))
    return out.select("feature", status.alias("status"), text.alias("reason"))


def table_profile(df: DataFrame, *, time: str | None = None, coverage_of: str | None = None, fresh_seconds: int = 604800) -> DataFrame:
    """Rows, event-time range, coverage, freshness deadline and an order-free content hash."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    aggs = [F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*cols)).alias("content_hash")]
    if time:
        aggs += [F.min(time).alias("min_event_time"), F.max(time).alias("max_event_time")]
    aggs.append((F.avg(F.col(coverage_of).isNotNull().cast("double")) if coverage_of else F.lit(1.0)).alias("coverage"))
    out = df.agg(*aggs)
    if time:
        out = out.withColumn("fresh_until", F.col("max_event_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(fresh_seconds).cast("decimal(18,6)")))
    return out


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts and hashes of two profiles agree."""
    pa, pb = table_profile(a), table_profile(b)
    same = lambda c: pa.select(c).scalar() == pb.select(c).scalar()
    return a.sparkSession.range(1).select((same("rows") & same("content_hash")).alias("same_content"))
