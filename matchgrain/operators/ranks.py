"""Exact ranks and quantiles without sorting a group in one task.

Values are counted per (group, value) first, so ties collapse before the shuffle;
running counts over value buckets then give every value its place. A bucket is a
1/4096 octave of the value: a bounded number of buckets per group, no pass over the
data to find the range, and the same answer in every evaluation of the plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.storage import cut_lineage
from matchgrain.operators.ordered import prior_totals

OCTAVE_STEPS = 4096
SMALLEST_OCTAVE = -64


def value_bucket(value) -> Column:
    """Whole number that never falls as the value rises."""
    v = F.col(value) if isinstance(value, str) else value
    size = F.abs(v)
    step = F.floor((F.log2(size) - SMALLEST_OCTAVE) * OCTAVE_STEPS) + 1
    beyond = (2**10 - SMALLEST_OCTAVE) * OCTAVE_STEPS + 2  # of infinite values
    return F.when(v == 0, F.lit(0)).otherwise(
        F.signum(v) * F.greatest(F.when(size == float("inf"), F.lit(beyond)).otherwise(step), F.lit(1))
    ).cast("bigint")


def value_ranks(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): `_cnt` rows, `_before` rows below, `_total` rows."""
    counted = (
        long.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_cnt"))
    )
    return prior_totals(
        counted, keys, ["_v"], value_bucket("_v"), sums={"_before": F.col("_cnt")}, totals={"_total": "_before"}
    )


def with_ranks(
    df: DataFrame,
    outputs: Mapping[str, str],
    *,
    group: Sequence[str] = (),
    method: str = "average",
    descending: bool = False,
    pct: bool = False,
) -> DataFrame:
    """Ranks of several columns in their group; `outputs` maps output name to column.

    Nulls stay null. Methods: average (ties share the mean rank) and min. All columns are
    ranked in one pass over (group, column number, value).
    """
    if method not in ("average", "min"):
        raise ValueError(f"Unsupported rank method {method!r}")
    sources = list(outputs.values())
    group_key = F.struct(F.lit(0).alias("z"), *[F.col(g) for g in group]).alias("_g")
    # Rows get a number, once and for good; all columns go long with it, are ranked together and come back by one grouping.
    rows = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()))
    number = lambda c: F.col(c).cast("double") + F.lit(0.0)
    long = rows.select("_id", group_key, F.inline(F.array(*[F.struct(F.lit(i).alias("_m"), number(c).alias("_v")) for i, c in enumerate(sources)])))
    long = long.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    table = value_ranks(long, ["_g", "_m"], "_v")
    below = F.col("_total") - F.col("_before") - F.col("_cnt") if descending else F.col("_before")
    rank = below + (F.col("_cnt") + 1) / F.lit(2.0) if method == "average" else below + 1
    if pct:
        rank = rank / F.col("_total")
    found = long.join(table.select("_g", "_m", "_v", rank.alias("_rank")), ["_g", "_m", "_v"])
    wide = found.groupBy("_id").agg(*[F.max(F.when(F.col("_m") == i, F.col("_rank"))).alias(name) for i, name in enumerate(outputs)])
    return rows.join(wide, "_id", "left").drop("_id")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, outputs: Mapping[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group, one row per group with a value."""
    table = value_ranks(df.select(*keys, F.col(value).cast("double").alias("_x")), keys, "_x")

    def at(index: Column) -> Column:
        inside = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_cnt"))
        return F.max(F.when(inside, F.col("_v")))

    picks: list[Column] = []
    finals: list[Column] = []
    for i, (name, p) in enumerate(outputs.items()):
        place = (F.col("_total") - 1) * F.lit(float(p))
        picks += [
            at(F.floor(place)).alias(f"_lo{i}"),
            at(F.ceil(place)).alias(f"_hi{i}"),
            F.max(place - F.floor(place)).alias(f"_f{i}"),
        ]
        finals.append(
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name)
        )
    return table.groupBy(*keys).agg(*picks).select(*keys, *finals)
