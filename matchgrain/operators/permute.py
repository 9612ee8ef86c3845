"""Row numbers without a sort, and pseudo-random permutations of them."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrain.functions.storage import cut_lineage

ROUNDS, WALK = 6, 64


def row_numbers(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(`df` with numbers from 0, number of rows): a count for each partition, running totals over these, no sort of rows."""
    placed = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    sizes = cut_lineage(placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n")))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_base"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    numbered = placed.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1))
    return numbered.drop("_part", "_base", "_id"), total


def permuted(number: Column, total: int, seed: int) -> Column:
    """Where a keyed permutation of 0 .. total - 1 takes a number: a bijection, the same in every evaluation.

    A Feistel network over pairs (a, b) of digits below side = ceil(sqrt(total)): a round maps (a, b) to (b, a + hash(b) mod side) and can be
    undone whatever the hash is. What lands at or beyond `total` is sent on until it lands below (cycle walking). Less than 2 / side
    of the square lies beyond, so WALK steps are never used up in practice; if they are, the job fails.
    """
    side = max(2, isqrt(max(total, 1) - 1) + 1)
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    digit = lambda c: c.cast("bigint")

    def once(x: Column) -> Column:
        start = F.struct(digit(F.floor(x / F.lit(side))).alias("a"), digit(F.pmod(x, F.lit(side))).alias("b"))
        step = lambda s, k: F.struct(s["b"].alias("a"), digit(F.pmod(s["a"] + F.pmod(F.xxhash64(F.lit(seed), k, s["b"]), F.lit(side)), F.lit(side))).alias("b"))
        return F.aggregate(rounds, start, step, lambda s: s["a"] * F.lit(side) + s["b"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(digit(number)), lambda x, _: F.when(x < total, x).otherwise(once(x)))
    return F.when(walked < total, walked).otherwise(F.raise_error(F.lit("a permutation did not come to an end")).cast("bigint"))
