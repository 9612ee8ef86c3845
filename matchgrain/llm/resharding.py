"""Resharding by minimum-cost flow: new shards of equal row counts from old ones, moving the fewest bytes.

The rows of an old shard are grouped into blocks by the binary length of their size, so a block's rows cost about
the same to move. From the row counts of the blocks and the capacities of the new shards, the flow says how many rows
of each block go to each new shard; a row that stays in the shard of its old number costs nothing, any other its
bytes. Only the table of blocks (old shards * 64 rows at most) and the flow reach the driver.

Each row has a rank in its block: the place among the rows of its cell (a bounded part of the block, by hash) plus the
rows of the cells before. Ranges of ranks go to the shards as the flow says, and give gapless slots there, so neither a shard nor a
block is ever one task.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a cell, on average.
CELL = 5_000


@dataclass(frozen=True)
class Block:
    shard: int
    kind: int
    rows: int
    size: int


class _Network:
    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, room: int, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y), self.room.append(r), self.cost.append(c)
        return len(self.to) - 2

    def send(self, source: int, sink: int) -> None:
        """Push all that fits from source to sink at least cost, by cheapest augmenting paths with node potentials."""
        price = [0.0] * len(self.out)
        while True:
            far = [float("inf")] * len(self.out)
            via = [-1] * len(self.out)
            far[source] = 0.0
            heap = [(0.0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    if self.room[e] and (next_ := d + self.cost[e] + price[a] - price[self.to[e]]) < far[self.to[e]] - 1e-9:
                        far[self.to[e]], via[self.to[e]] = next_, e
                        heapq.heappush(heap, (next_, self.to[e]))
            if via[sink] < 0:
                return
            price = [p + min(f, far[sink]) for p, f in zip(price, far)]
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.to[via[node] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def cheapest_flow(blocks: list[Block], shards: int) -> dict[Block, list[int]]:
    """Rows of each block for each new shard: counts at most one apart, fewest bytes moved."""
    total = sum(b.rows for b in blocks)
    base, extra = divmod(total, shards)
    source, sink, spare = 0, 1, 2
    net = _Network(3 + shards + len(blocks))
    arcs = {}
    for k, block in enumerate(blocks):
        node = 3 + shards + k
        net.arc(source, node, block.rows, 0.0)
        arcs[block] = [net.arc(node, 3 + j, block.rows, 0.0 if j == block.shard else block.size / block.rows) for j in range(shards)]
    for j in range(shards):
        net.arc(3 + j, sink, base, 0.0)
        net.arc(3 + j, spare, 1, 0.0)
    net.arc(spare, sink, extra, 0.0)
    net.send(source, sink)
    return {block: [net.room[e ^ 1] for e in es] for block, es in arcs.items()}


def _measured(docs: DataFrame, shard: Column) -> DataFrame:
    """One struct per row of `docs`, so that its names cannot clash, and what placing needs beside it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    return docs.select(
        F.struct("*").alias("_row"),
        F.coalesce(shard.cast("int"), F.lit(0)).alias("old_shard"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.length(F.bin(size)).alias("_kind"),
        F.xxhash64("doc_id", "text").alias("_hash"),
    )


def _ranked(placed: DataFrame, keys: list[str], counts: list[tuple], schema: str) -> DataFrame:
    """`_rank` of each row in its group of `keys`, from 0 without gaps; `counts` are the groups and their rows.

    Cells lie in ranges over the tasks: a task holds ranks that follow each other, so few shards are written by each task.
    """
    cells = placed.sparkSession.createDataFrame([(*group, -(-n // CELL)) for *group, n in counts], f"{schema}, _cells int")
    placed = placed.join(F.broadcast(cells), keys).withColumn("_cell", F.pmod("_hash", F.col("_cells"))).drop("_cells")
    cell = [*keys, "_cell"]
    before = placed.groupBy(cell).agg(F.count("*").alias("_n"))
    before = before.select(*cell, (F.sum("_n").over(W.partitionBy(*keys).orderBy("_cell")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy(*cell).orderBy("_hash", F.col("_row.doc_id"))) - 1
    ranked = placed.repartitionByRange(*cell).withColumn("_rank", place)
    return ranked.join(before, cell).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before")


def _opened(rows: DataFrame, *added: str) -> DataFrame:
    names = [f.name for f in rows.schema["_row"].dataType.fields if f.name not in added]
    return rows.select(*[F.col("_row").getField(n).alias(n) for n in names], *added)


ADDED = ("size", "text_crc32", "old_shard", "slot", "shard")


def reshard(docs: DataFrame, old_shard: Column, shards: int = 16) -> tuple[DataFrame, list[int]]:
    """(rows, affected): every row of `docs` with its new place, and the new shards whose files change.

    rows has the columns of `docs` and size (UTF-8 bytes of text, 0 for null, plus 1), text_crc32, old_shard, shard and slot; a column
    of one of these names is replaced, all others are kept, whatever their names. Slots count from 0 without gaps in each shard; row
    counts of shards are at most one apart. A null old shard counts as shard 0. The old number may exceed the new ones; such shards
    dissolve. Repeated rows each have a slot of their own (which of them has which is open); an empty table gives no rows.
    """
    placed = _measured(docs, old_shard)
    tally = placed.groupBy("old_shard", "_kind").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    blocks = [Block(r["old_shard"], r["_kind"], r["rows"], r["bytes"]) for r in sorted(tally, key=lambda r: (r["old_shard"], r["_kind"]))]
    flow = cheapest_flow(blocks, shards)
    spark, filled, ranges, affected = docs.sparkSession, [0] * shards, [], set()
    for block, parts in flow.items():
        low = 0
        for shard in sorted(range(shards), key=lambda j: (j != block.shard, j)):
            if parts[shard]:
                ranges.append((block.shard, block.kind, low, low + parts[shard], shard, filled[shard]))
                low, filled[shard] = low + parts[shard], filled[shard] + parts[shard]
                if shard != block.shard:
                    affected |= {shard, block.shard}
    schema = "old_shard int, _kind int"
    ranked = _ranked(placed, ["old_shard", "_kind"], [(b.shard, b.kind, b.rows) for b in blocks], schema)
    # At most old shards * 64 * new shards rows.
    spans = spark.createDataFrame(ranges, f"{schema}, _low long, _high long, shard int, _first long")
    rows = ranked.join(F.broadcast(spans), ["old_shard", "_kind"]).where("_rank >= _low and _rank < _high")
    rows = rows.withColumn("slot", F.col("_first") + F.col("_rank") - F.col("_low"))
    return _opened(rows, *ADDED), sorted(a for a in affected if a < shards)


def _write(rows: DataFrame, folder: str, mode: str) -> None:
    rows.sortWithinPartitions("shard", "slot").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)


def write_layout(docs: DataFrame, shard: Column, folder: str) -> None:
    """Write `docs` into a new folder as folder/shard=N with the columns of `reshard`'s rows; slots without gaps, a null shard is 0."""
    placed = _measured(docs, shard)
    counts = [tuple(r) for r in placed.groupBy("old_shard").count().collect()]
    ranked = _ranked(placed, ["old_shard"], counts, "old_shard int")
    _write(_opened(ranked.withColumns({"shard": F.col("old_shard"), "slot": F.col("_rank").cast("long")}), *ADDED), folder, "error")


def rewrite_affected(rows: DataFrame, affected: list[int], folder: str, shards: int = 16) -> None:
    """Rewrite the files of the affected shards in folder/shard=N; the others stay as they are.

    `rows` may come from reading the folder itself: files are replaced when the job is committed. Then the folders of shards
    that dissolve (N >= `shards`) or keep no row are deleted, so that a row that has moved is there once. Between commit and
    deletion moved rows are there twice; readers wait until the call returns. `rows` cannot be evaluated afterwards.
    """
    spark, seen = rows.sparkSession, Observation()
    out = rows.where(F.col("shard").isin(affected)) if affected else rows.limit(0)
    _write(out.observe(seen, F.collect_set("shard").alias("shards")), folder, "overwrite")
    filled = set(seen.get["shards"])
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in files.listStatus(root):
        name, _, number = entry.getPath().getName().partition("=")
        if name == "shard" and (int(number) >= shards or (int(number) in affected and int(number) not in filled)):
            files.delete(entry.getPath(), True)
