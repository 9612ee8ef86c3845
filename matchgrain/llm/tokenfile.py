"""Token ids in Parquet list columns: dictionary-coded ids, delta-coded metadata, small row groups and page indexes.

A data set is a folder of Parquet files, one per range of doc_id, in ascending order of `part`:

    part int, doc_id long, local_start long, n_tokens int, ids list<int>

Metadata columns are delta-packed (format version 2, no dictionary), ids are dictionary indexes bit-packed to the size of
the vocabulary in use. Row groups and pages are small and carry column and offset indexes, so a reader of
metadata never touches ids, and a filter on doc_id reads the pages that hold it. The global start of a document is
its local start plus the ids of all parts before; the part totals are one row a file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrain.functions.storage import cut_lineage
from matchgrain.llm.chunkids import chunk_ids, word_chunks
from matchgrain.llm.textcore import bounded

SCHEMA = "part int, doc_id long, local_start long, n_tokens int, ids array<int>"
#: Files whose totals are broadcast at most; more are joined.
FEW_FILES = 100_000
#: Text bytes for one file; bytes of a row group and of a page.
FILE_BYTES, GROUP_BYTES, PAGE_BYTES = 32 << 20, 16 << 20, 64 << 10


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int):
    encoder, part, start = chunk_ids(path, word_chunks), TaskContext.get().partitionId(), 0
    for batch in bounded(batches, "text", 4 << 20):
        ids, offsets = encoder.encoded_with_end(batch.column(1), end)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(batch.num_rows, part, np.int32)),
                batch.column(0),
                pa.array(start + offsets[:-1]),
                pa.array(np.diff(offsets).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
            ],
            ["part", "doc_id", "local_start", "n_tokens", "ids"],
        )
        start += int(offsets[-1])


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = 1, file_bytes: int = FILE_BYTES) -> None:
    """Encode each row of `docs` (doc_id, text) with the vocabulary at `path`, a `tokenizers` file that drops white space, append id `end`, and write the data set.

    Rows lie in ascending order of doc_id (null first; equal ids by a hash of the text); every row is a document of its
    own, repeated ones too; a null or empty text is only the end id. Other columns are not kept.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "xxhash64(text) tie")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    ordered = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("part", "doc_id", "local_start", "n_tokens")},
        "parquet.block.size": str(GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": "1000",
    }
    ordered.mapInArrow(lambda b: _encode(b, path, end), SCHEMA).write.options(**options).parquet(folder)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(part, doc_id, start, n_tokens): reads no ids. start: ids of all documents before."""
    meta = spark.read.schema(SCHEMA).parquet(folder).select("part", "doc_id", "local_start", F.col("n_tokens").cast("long").alias("n_tokens"))
    return _with_start(meta, meta)


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids) of all documents or of some; the filter reaches the page index."""
    rows = spark.read.schema(SCHEMA).parquet(folder).withColumn("n_tokens", F.col("n_tokens").cast("long"))
    return _with_start(rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids)), rows)


def _with_start(rows: DataFrame, everything: DataFrame) -> DataFrame:
    # One row a file: its window is the one task that sees all files.
    totals = everything.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total"))
    totals = cut_lineage(totals)
    bases = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    if totals.count() <= FEW_FILES:
        bases = F.broadcast(bases)
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start")


def _checksums(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten().to_numpy(False).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(False))])
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from rows of `read_tokens`; the CRC is over the ids as little-endian 32-bit numbers."""
    return rows.select("doc_id", "start", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
