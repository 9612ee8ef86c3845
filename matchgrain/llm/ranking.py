"""Ranked lexical search by pipelined term partitioning.

Every term has one owner, and owners stand in a row of stages. A bundle of items (queries) visits the stages one after the
other and carries sparse accumulators, document to score so far. A stage is a cogroup of the bundles with the posting
lists of its owner; it adds the whole-number contributions of its terms and hands the bundles on. The last stage selects.

* Postings are cut into blocks of documents (about BLOCK_BYTES of text), and a bundle is for one block and up to about
  ITEMS_A_BUNDLE items. So a term that all documents hold is many short lists, and no group grows with the data.
* Owners are bands of document frequency with about equal numbers of postings, rare terms first: the accumulators that
  travel come from the rarer terms, and the frequent ones meet them in the last stage, which sends on 50 rows an item.
* Only terms of items are indexed: a hash filter of bounded size goes to the scan, the join on terms is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrain.functions.storage import cut_lineage
from matchgrain.llm.rawtext import HashFilter, hash_filter, raw_bytes, strings_of
from matchgrain.llm.tables import stored
from matchgrain.llm.textcore import bounded, words_of

#: Terms: ASCII letters and digits, and all beyond ASCII; A-Z lower-cased. Other bytes become a space.
_BYTES = np.arange(256, dtype=np.uint8)
TERM_BYTES = np.where(np.char.isalnum(_BYTES.view("S1")) | (_BYTES >= 128), _BYTES, np.uint8(32)).astype(np.uint8)
TERM_BYTES[65:91] += 32

BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 1 << 15
STAGES, ITEMS_A_BUNDLE, FINAL_SHARDS = 3, 64, 64
#: Rows of (term, bundle) whose weights are broadcast at most; more are joined.
FEW_TERMS = 500_000
POSTINGS = "block long, term string, size long, total long, docs binary, tf binary, doc_ids array<long>, lengths array<int>"
BUNDLE = "block long, bundle long, doc_ids array<long>, lengths array<int>, items array<long>, docs array<binary>, scores array<binary>"
FOUND = "block long, item_no long, doc_id long, score long"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(id of each term, the distinct terms as bytes, offset of each text's first term)."""
    data, offsets = raw_bytes(texts)
    return words_of(strings_of(TERM_BYTES[data], offsets), lower=False)


def _hashes(vocabulary: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_numpy(zero_copy_only=False)), np.uint64, len(vocabulary))


def _item_terms(batches: Iterator[pa.RecordBatch]):
    for batch in bounded(batches, "text"):
        ids, vocabulary, offsets = terms_of(batch.column(1))
        rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), vocabulary.cast(pa.string()).take(pa.array(ids, pa.int64())), pa.array(_hashes(vocabulary).view(np.int64)[ids] if len(ids) else np.empty(0, np.int64))],
            ["item_id", "term", "h"],
        )


def _lists(data: np.ndarray, width: int, starts: np.ndarray) -> pa.Array:
    """Binary values, one after the other in `data`; starts: the first entry of each, and the end."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _postings(batches: Iterator[pa.RecordBatch], shared):
    wanted: HashFilter = shared.value
    block = TaskContext.get().partitionId() << 32
    for whole in bounded(batches, "text", BLOCK_BYTES):
        for base in range(0, whole.num_rows, BLOCK_DOCS):
            batch = whole.slice(base, BLOCK_DOCS)
            n = batch.num_rows
            ids, vocabulary, offsets = terms_of(batch.column(1))
            lengths = np.diff(offsets)
            asked = np.flatnonzero(wanted.has(_hashes(vocabulary)))
            number = np.full(len(vocabulary), -1, np.int64)
            number[asked] = np.arange(len(asked))
            term, doc = number[ids] if len(ids) else np.empty(0, np.int64), np.repeat(np.arange(n), lengths)
            keys, tf = np.unique(term[term >= 0] * n + doc[term >= 0], return_counts=True)
            starts = np.searchsorted(keys, np.arange(len(asked) + 1) * n)
            none = pa.nulls(len(asked), pa.list_(pa.int64())), pa.nulls(len(asked), pa.list_(pa.int32()))
            head = [[block], [""], [int((lengths > 0).sum())], [int(lengths.sum())], [None], [None]]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            names = ["block", "term", "size", "total", "docs", "tf", "doc_ids", "lengths"]
            first = [pa.array(h, k) for h, k in zip(head, kinds)]
            first += [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (batch.column(0), pa.array(lengths.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(first, names)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(asked), block)), vocabulary.cast(pa.string()).take(pa.array(asked)), pa.array(np.diff(starts)), pa.array(np.zeros(len(asked), np.int64)),
                    _lists((keys % n).astype(np.uint16), 2, starts), _lists(tf.astype(np.uint32), 4, starts), *none,
                ],
                names,
            )
            block += 1


def _stage(bundle: pa.Table, postings: pa.Table, n_docs: int, n_terms: int, select: int):
    """One owner's visit: add what its terms give; select > 0: the last one, which sends on that many documents an item."""
    lengths = bundle.column("lengths").combine_chunks().flatten().to_numpy(False).astype(np.int64)
    measure = 100 - 50 + (50 * lengths * n_docs) // max(n_terms, 1)
    scores: dict[int, np.ndarray] = {}
    columns = [bundle.column(c).combine_chunks().flatten() for c in ("items", "docs", "scores")]
    for item, docs, values in zip(*(c.to_pylist() for c in columns)):
        scores[item] = np.zeros(len(lengths), np.int64)
        scores[item][np.frombuffer(docs, np.uint16)] = np.frombuffer(values, np.int64)
    for items, weight, docs, tf in zip(*(postings.column(c).to_pylist() for c in ("items", "weight", "docs", "tf"))):
        at, f = np.frombuffer(docs, np.uint16), np.frombuffer(tf, np.uint32).astype(np.int64)
        gain = weight * ((1_000_000_000 * f) // (1000 * f + 20 * measure[at]))
        for item in items:
            if item not in scores:
                scores[item] = np.zeros(len(lengths), np.int64)
            scores[item][at] += gain
    sparse = {item: np.flatnonzero(s > 0) for item, s in sorted(scores.items())}
    if not select:
        kept = [(item, at.astype(np.uint16).tobytes(), scores[item][at].tobytes()) for item, at in sparse.items() if len(at)]
        carried = [pa.array([[k[i] for k in kept]], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))]
        return pa.Table.from_arrays([*(bundle.column(c) for c in ("block", "bundle", "doc_ids", "lengths")), *carried], ["block", "bundle", "doc_ids", "lengths", "items", "docs", "scores"])
    ids = bundle.column("doc_ids").combine_chunks().flatten()
    order = ids.fill_null(0).to_numpy(False)
    known = ids.is_valid().to_numpy(False)
    found = [np.empty((0, 3), np.int64)]
    for item, at in sparse.items():
        s = scores[item][at]
        if len(at) > select:
            high = s >= np.partition(s, len(s) - select)[len(s) - select]
            at, s = at[high], s[high]
        best = np.lexsort((order[at], known[at], -s))[:select]
        found.append(np.stack([np.full(len(best), item), at[best], s[best]], 1))
    table = np.concatenate(found)
    block = bundle.column("block")[0].as_py()
    return pa.Table.from_arrays([pa.array(np.full(len(table), block)), pa.array(table[:, 0]), ids.take(pa.array(table[:, 1])), pa.array(table[:, 2])], ["block", "item_no", "doc_id", "score"])


def _visit(n_docs: int, n_terms: int, select: int):
    return lambda bundle, postings: _stage(bundle, postings, n_docs, n_terms, select)


def _owners(frequencies: DataFrame) -> DataFrame:
    """(band, owner): bands of document frequency, a quarter octave each, dealt to STAGES owners with about equal postings."""
    bands = frequencies.groupBy("band").agg(F.sum("df").alias("volume"))  # at most some 250 rows
    upto = W.partitionBy(F.lit(0)).orderBy("band")
    share = (F.sum("volume").over(upto) - F.col("volume")) / F.sum("volume").over(W.partitionBy(F.lit(0)))
    return bands.select("band", F.floor(share * STAGES).cast("int").alias("owner"))


def search(docs: DataFrame, benchmark: DataFrame, top: int = 50) -> DataFrame:
    """(item_id, rank int, doc_id, score): the `top` best rows of `docs` (doc_id, text) for each item of `benchmark` (item_id, text).

    The score sums, over the distinct terms of an item, weight * (10^9 tf div (1000 tf + 20 m)), with weight
    floor(1000 ln((2N + 2) / (2 df + 1))) and m = 50 + 50 n N div L; see `_stage`. Equal scores go by ascending doc_id, rows
    without one first. Each row of `docs` is a document, repeated rows too; null and empty texts have no terms and are
    never found. Rows of `benchmark` with one item_id are one item (the null is an item too); items without terms, or
    whose terms no document holds, have no rows. Long texts are taken whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").mapInArrow(_item_terms, "item_id long, term string, h long").distinct()
    asked = cut_lineage(asked)
    items = cut_lineage(asked.select("item_id").distinct().withColumn("item_no", F.monotonically_increasing_id()))
    n_items = items.count()
    if not n_items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    n_bundles = -(-n_items // ITEMS_A_BUNDLE)
    terms = asked.select("term", "h").distinct()
    shared = spark.sparkContext.broadcast(hash_filter(terms, "h", terms.count()))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    index = stored(rows.mapInArrow(lambda b: _postings(b, shared), POSTINGS), "postings")

    heads, lists = index.where("term = ''"), index.where("term <> ''")
    n_docs, n_terms = heads.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    frequencies = lists.groupBy("term").agg(F.sum("size").alias("df")).withColumn("band", F.floor(F.log2("df") * 4).cast("int"))
    weight = F.floor(1000 * F.ln(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    owned = asked.join(items, asked["item_id"].eqNullSafe(items["item_id"]))
    owned = owned.groupBy("term", F.pmod(F.xxhash64("item_no"), F.lit(n_bundles)).alias("bundle")).agg(F.collect_list("item_no").alias("items"))
    frequencies = cut_lineage(frequencies)
    weights = frequencies.join(_owners(frequencies), "band").select("term", "owner", weight.cast("long").alias("weight"))
    owned = cut_lineage(owned.join(weights, "term"))
    few = owned.count() <= FEW_TERMS

    empty = [F.lit(None).cast(t).alias(c) for c, t in (("items", "array<long>"), ("docs", "array<binary>"), ("scores", "array<binary>"))]
    bundles = heads.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bundles - 1).cast("long"))).alias("bundle"), "doc_ids", "lengths", *empty)
    for stage in range(STAGES):
        mine = owned.where(F.col("owner") == stage).drop("owner")
        visited = lists.select("block", "term", "docs", "tf").join(F.broadcast(mine) if few else mine, "term").select(F.col("block").alias("of_block"), F.col("bundle").alias("of_bundle"), "items", "weight", "docs", "tf")
        last = top if stage == STAGES - 1 else 0
        bundles = bundles.groupBy("block", "bundle").cogroup(visited.groupBy("of_block", "of_bundle")).applyInArrow(_visit(n_docs, n_terms, last), FOUND if last else BUNDLE)
    # Spark cuts to `top` rows a key before each shuffle; two steps, so that no task sees more than FINAL_SHARDS * top rows of an item.
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    shard = F.pmod(F.xxhash64("block"), F.lit(FINAL_SHARDS))
    best = bundles.withColumn("_shard", shard).withColumn("rank", F.row_number().over(W.partitionBy("item_no", "_shard").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("item_no").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(items, "item_no").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
