"""Isotonic regression as a mergeable summary: pools of adjacent forecasts, merged in a tree of tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.storage import cut_lineage

POOL = ("low", "high", "hits", "weight", "moment")
POOLS = "node long, low double, high double, hits double, weight double, moment double"


def pooled(rows: Iterable[tuple]) -> list[list[float]]:
    """Pool adjacent violators over (low, high, hits, weight, moment) in ascending order; the rates of what comes out rise strictly."""
    stack: list[list[float]] = []
    for row in rows:
        stack.append(list(row))
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            _, high, hits, weight, moment = stack.pop()
            left = stack[-1]
            left[1], left[2], left[3], left[4] = high, left[2] + hits, left[3] + weight, left[4] + moment
    return stack


def _batch(pools: list[list[float]], node: int) -> pa.RecordBatch:
    columns = [pa.array([node] * len(pools), pa.int64())] + [pa.array([float(p[i]) for p in pools], pa.float64()) for i in range(5)]
    return pa.RecordBatch.from_arrays(columns, ["node", *POOL])


def _rows(table) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in POOL))


def _leaf(batches: Iterator[pa.RecordBatch]):
    stack = pooled(row for batch in batches for row in _rows(pa.Table.from_batches([batch])))
    yield _batch(stack, TaskContext.get().partitionId())


def _merge(table: pa.Table) -> pa.Table:
    """The violating pools of two neighbours, pooled."""
    ordered = table.sort_by("low")
    return pa.Table.from_batches([_batch(pooled(_rows(ordered)), ordered.column("node")[0].as_py())])


def isotonic_pools(points: DataFrame, partitions: int | None = None) -> DataFrame:
    """(low, high, hits, weight, moment): the pools of an isotonic fit of rate = hits / weight on p, in no order.

    `points` has p, hits and weight, each p once; moment sums p * weight. Range partitions pool themselves. Then neighbours are merged, level by
    level: only pools of the left one whose rate reaches the least rate of the right one, and the other way round, can ever be pooled with the
    other side, so only these move to the merging task; the others stay as rows. A level is one small grouping and one merge; there are log2(partitions) of them.
    """
    width = partitions or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = points.select(F.col("p").alias("low"), F.col("p").alias("high"), "hits", "weight", (F.col("p") * F.col("weight")).alias("moment"))
    pools = cut_lineage(rows.repartitionByRange(width, "low").sortWithinPartitions("low").mapInArrow(_leaf, POOLS))
    span = 1
    while span < width:
        rate = F.col("hits") / F.col("weight")
        ends = cut_lineage(pools.groupBy("node").agg(F.min(rate).alias("least"), F.max(rate).alias("most")))  # a row for each node
        right = ends.select((F.col("node") - span).alias("node"), F.col("least").alias("edge")).where(F.col("node") % (2 * span) == 0)
        left = ends.select((F.col("node") + span).alias("node"), F.col("most").alias("edge")).where(F.col("node") % (2 * span) == span)
        faced = pools.join(right.unionByName(left), "node", "left")
        on_left = F.col("node") % (2 * span) == 0
        moves = F.coalesce(F.when(on_left, rate >= F.col("edge")).otherwise(rate <= F.col("edge")), F.lit(False))
        faced = faced.withColumn("_moves", moves).withColumn("node", F.col("node") - F.col("node") % (2 * span)).drop("edge")
        merged = faced.where("_moves").drop("_moves").groupBy("node").applyInArrow(_merge, POOLS)
        pools = cut_lineage(faced.where("not _moves").select(merged.columns).unionByName(merged))
        span *= 2
    return pools.drop("node")
