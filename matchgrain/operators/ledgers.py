"""Immutable forecast ledgers, set comparisons, pool fixtures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.contracts import guard, require

LEDGER_KEY = ("fixture_id", "issued_at", "model_id")
RESULT_COLUMNS = (
    "actual_outcome", "actual_home_goals", "actual_away_goals", "result_ingested_at", "closing_price", "closing_line_value",
)


def append_forecast_ledger(existing: DataFrame, additions: DataFrame) -> DataFrame:
    """New keys are added, forecast fields may not change, result fields are filled once.

    One full outer join; a broken rule fails the job. Write the result as a new snapshot.
    """
    require(additions, LEDGER_KEY, "forecast ledger columns")
    both = [c for c in existing.columns if c in additions.columns and c not in LEDGER_KEY]
    extra = [c for c in additions.columns if c not in existing.columns and c not in LEDGER_KEY]
    if "kickoff_utc" in additions.columns:
        additions = guard(additions, F.col("issued_at") < F.col("kickoff_utc"), "forecast must be issued before kickoff")

    def packed(df: DataFrame, name: str, message: str) -> DataFrame:
        rest = [c for c in df.columns if c not in LEDGER_KEY]
        one = df.groupBy(*LEDGER_KEY).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias(name))
        return guard(one, F.col("_n") == 1, message).drop("_n")

    old = packed(existing, "_old", "existing ledger contains duplicate immutable keys")
    new = packed(additions, "_new", "ledger additions contain duplicate immutable keys")
    joined = old.join(new, list(LEDGER_KEY), "full")
    matched = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    same, open_results = F.lit(True), F.lit(True)
    for c in both:
        before, after = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        if c in RESULT_COLUMNS:
            open_results = open_results & (before.isNull() | after.isNull() | (before == after))
        else:
            same = same & before.eqNullSafe(after)
    joined = guard(joined, ~matched | same, "immutable forecast field changed")
    joined = guard(joined, ~matched | open_results, "result field was already finalized")
    columns = [F.col(k) for k in LEDGER_KEY]
    for c in existing.columns:
        if c in LEDGER_KEY:
            continue
        columns.append((F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c in both else F.col(f"_old.{c}")).alias(c))
    columns += [F.col(f"_new.{c}").alias(c) for c in extra]
    return joined.select(*columns)


def set_difference(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, tagged missing / unexpected."""
    left, right = expected.select(*keys).distinct(), observed.select(*keys).distinct()
    missing = left.join(right, list(keys), "left_anti").withColumn("difference", F.lit("missing"))
    return missing.unionByName(right.join(left, list(keys), "left_anti").withColumn("difference", F.lit("unexpected")))


def pool_fixtures(pools: DataFrame, *, repeats: int = 1, keys: Sequence[str] = ("edition_id", "pool")) -> DataFrame:
    """Every unordered pair of a pool, `repeats` times with alternating venue.

    The pairs are the schedule itself; pool sizes are fixed by the competition rules.
    """
    if repeats < 1:
        raise ValueError("fixture repeats must be positive")
    a = pools.select(*keys, F.col("rank").alias("_ra"), F.col("team_id").alias("_a"))
    b = pools.select(*keys, F.col("rank").alias("_rb"), F.col("team_id").alias("_b"))
    pairs = a.join(b, list(keys)).where("_ra < _rb").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    first = F.col("repeat") % 2 == 1
    return pairs.select(
        *keys, F.when(first, F.col("_a")).otherwise(F.col("_b")).alias("home_team_id"),
        F.when(first, F.col("_b")).otherwise(F.col("_a")).alias("away_team_id"), "repeat",
    )


def bracket_paths(rules: DataFrame) -> DataFrame:
    """One row per source of each bracket (phase_id, bracket_id, sources[], legs, outcome_label)."""
    return rules.select("phase_id", "bracket_id", F.posexplode("sources").alias("slot", "source"), "legs", "outcome_label")
