"""Near-duplicate documents by MinHash bands, odd sketches and exact set similarity.

The distinct word shingles of a document give `samples` MinHash values. Runs of `rows` values are the keys
of its LSH buckets. All samples are folded into a parity bitmap of `bits` bits (odd sketch): each pair
(sample number, value) flips one bit, so the population count of the XOR of two bitmaps estimates how
many samples differ, and is precise where similarity is high. Bucket mates whose bitmaps differ by more
than a linked pair ever does (`spread` standard deviations) are no candidates; the rest is confirmed on the full sets.

Work follows the number of documents, not the number of pairs:
* Documents with equal sets form a class; only one of each class goes on.
* In a bucket, all members are compared with one hub, the member that shares most buckets with others.
  The links found give components. What lies in the largest component of its bucket needs no more
  comparison with its own kind; only members outside it (few, as a rule) meet the other members, in
  blocks, inside the join condition: different components, sizes and the count shared with the hub that
  allow the threshold, close bitmaps, and the first of their common buckets. Pairs that fail are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.storage import cut_lineage
from matchgrain.llm.graph import components
from matchgrain.llm.textcore import bounded, hashed_words, mix, run_hashes

BLOCK = 1024


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of each text.

    With fewer than `words` words the whole sequence is the one shingle; without words the set is empty.
    """
    hashes, offsets = hashed_words(texts, lower=True)
    counts = np.diff(offsets)
    grams = run_hashes(hashes, words)
    rows = np.repeat(np.arange(len(counts)), np.maximum(counts - words + 1, 0))
    within = np.arange(len(rows)) - np.repeat(np.cumsum(np.maximum(counts - words + 1, 0)) - np.maximum(counts - words + 1, 0), np.maximum(counts - words + 1, 0))
    values = grams[offsets[:-1][rows] + within] if len(rows) else np.empty(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        whole = np.array([mix(run_hashes(hashes[offsets[i] : offsets[i + 1]], int(counts[i])) + np.uint64(counts[i]))[0] for i in short], np.uint64)
        rows, values = np.concatenate([rows, short]), np.concatenate([values, whole])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(counts)))]).astype(np.int64)


def signatures(values: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """MinHash values, one row per sample, of the nonempty sets that begin at `starts`."""
    multipliers = mix(np.arange(1, samples + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((samples, len(starts)), np.uint32)
    high = (values >> np.uint64(32)).astype(np.uint32)
    low = values.astype(np.uint32)
    for k in range(samples):
        a, b = np.uint32(multipliers[k] >> np.uint64(32)) | np.uint32(1), np.uint32(multipliers[k] & np.uint64(0xFFFFFFFF)) | np.uint32(1)
        mixed = (high * a) ^ (low * b)
        mixed ^= mixed >> np.uint32(15)
        out[k] = np.minimum.reduceat(mixed * a, starts)
    return out


def odd_sketch(signature: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps (one row of bits / 64 words per set) of the columns of `signature`."""
    samples, n = signature.shape
    sketch = np.zeros((n, bits // 64), np.uint64)
    rows = np.arange(n)
    for k in range(samples):
        place = mix((signature[k].astype(np.uint64) << np.uint64(16)) + np.uint64(k)) % np.uint64(bits)
        sketch[rows, (place >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (place & np.uint64(63))
    return sketch


def most_different_bits(samples: int, bits: int, threshold: float, spread: float) -> int:
    """Differing bits that two sets of similarity `threshold` stay under, by `spread` standard deviations."""
    differing = samples * (1 - threshold)
    decay = math.exp(-4 * differing / bits)
    mean = bits / 2 * (1 - decay)
    slope = 2 * decay
    variance = slope**2 * samples * threshold * (1 - threshold) + bits / 4 * (1 - decay**2)
    return math.ceil(mean + spread * math.sqrt(variance))


def _sign(batches: Iterator[pa.RecordBatch], words: int, samples: int, rows: int, bands: int, bits: int):
    import xxhash

    for batch in bounded(batches, "text", 4 << 20):
        values, offsets = shingle_sets(batch.column(1), words)
        counts = np.diff(offsets)
        full = np.flatnonzero(counts)
        digests, keys, sketches = [None] * len(counts), [None] * len(counts), [None] * len(counts)
        if len(full):
            signature = signatures(values, offsets[full], samples)
            sketch = odd_sketch(signature, bits).view(np.int64)
            key = np.empty((len(full), bands), np.uint64)
            for band in range(bands):
                folded = np.full(len(full), band, np.uint64)
                for k in range(band * rows, band * rows + rows):
                    folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + signature[k])
                key[:, band] = folded
            key = key.view(np.int64)
            for at, i in enumerate(full):
                digests[i] = xxhash.xxh3_128_digest(values[offsets[i] : offsets[i + 1]].tobytes())
                keys[i], sketches[i] = key[at], sketch[at]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
            ["id", "n_shingles", "digest", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int):
    for batch in bounded(batches, "text", 4 << 20):
        values, offsets = shingle_sets(batch.column(1), words)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "shingles"])


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """`pairs` (u, v) with `shared` and `linked`, from the full sets of both."""
    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    sets = cut_lineage(texts.join(wanted, "id", "left_semi").mapInArrow(lambda b: _sets(b, words), "id long, shingles array<long>"))
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    counted = pairs.join(left, "u").join(right, "v").select(
        "u", "v", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), (F.size("a") + F.size("b")).cast("long").alias("total")
    )
    return counted.select("u", "v", "shared", (100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).alias("linked"))


def near_duplicates(
    docs: DataFrame, words: int = 3, percent: int = 85, samples: int = 1024, rows: int = 4, bands: int = 18, bits: int = 2048, spread: float = 5.0
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id, n_links) for each row of `docs` (doc_id, text).

    Two documents are linked if 100 * |A and B| >= `percent` * |A or B| of their sets of `words`-word
    shingles; component_id is the smallest doc_id that links reach, class_id the smallest with the same set,
    n_links the number of confirmed links of the class that were needed (not all links of a group).
    A null, empty or blank text has no set, links with nothing and keeps its own id. A null doc_id takes
    no part: component_id is null and the row is kept. Rows that repeat a doc_id each come out once; as
    one id has one text in `documents`, the set of any of them stands for the id. Other columns are ignored.
    With `bands` bands of `rows` samples a pair at the threshold misses every bucket with a chance of
    (1 - t^rows)^bands, 2e-6 at the defaults, and is cut by the bitmaps with about 3e-7.
    """
    if bands * rows > samples or bits % 64:
        raise ValueError("bands * rows may not exceed samples; bits is a multiple of 64")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    signed = cut_lineage(
        texts.mapInArrow(
            lambda b: _sign(b, words, samples, rows, bands, bits),
            "id long, n_shingles long, digest binary, bands array<long>, sketch array<long>",
        )
    )
    classes = cut_lineage(
        signed.where("digest is not null and id is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    seats = classes.select("id", F.explode("bands").alias("bucket"))
    shared = seats.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    seats = cut_lineage(seats.join(shared, "bucket"))
    fame = seats.groupBy("id").agg(F.sum("members").alias("fame"))
    famed = seats.join(fame, "id")
    hubs = famed.groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("id")).alias("less"))).alias("top")).select("bucket", (-F.col("top.less")).alias("hub"))
    facts = classes.select("id", "n", "sketch", "bands")
    seats = cut_lineage(seats.join(hubs, "bucket"))
    spokes = seats.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    most = most_different_bits(samples, bits, percent / 100, spread)

    def apart(a: str, b: str):
        words_ = [F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(bits // 64)]
        return sum(words_[1:], words_[0])

    near = (
        spokes.join(facts.alias("a"), F.col("u") == F.col("a.id"))
        .join(facts.alias("b"), F.col("v") == F.col("b.id"))
        .where((100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & (apart("a", "b") <= most))
        .select("u", "v")
    )
    tested = cut_lineage(_confirm(cut_lineage(near), texts, words, percent))
    first = cut_lineage(components(tested.where("linked")))

    # Members outside the largest component of their bucket meet the others of the bucket.
    placed = (
        seats.where("members > 2")
        .join(first, "id", "left")
        .join(tested.select(F.col("u").alias("hub"), F.col("v").alias("id"), "shared"), ["hub", "id"], "left")
        .select("bucket", "id", "members", "hub", F.coalesce("component", "id").alias("component"), "shared")
    )
    placed = cut_lineage(placed)
    tally = placed.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    largest = tally.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("all"))
    largest = largest.where("top.k < all").select("bucket", F.col("top.component").alias("main"), (F.col("all") - F.col("top.k")).alias("outside"))
    open_ = cut_lineage(placed.join(largest, "bucket").join(facts, "id"))
    salt = F.xxhash64("id", "bucket")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    outer = F.ceil(F.col("outside") / BLOCK).cast("int")
    everyone = open_.withColumn("i", F.pmod(salt, blocks)).withColumn("j", F.explode(F.sequence(F.lit(0), outer - 1)))
    outsiders = open_.where("component <> main").withColumn("j", F.pmod(salt, outer).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # With the hub: what two sets share lies in what both share with it, or outside it in both.
    together = F.least("a.shared", "b.shared") + F.least(F.col("a.n") - F.col("a.shared"), F.col("b.n") - F.col("b.shared"))
    possible = F.coalesce(F.least(together, F.least("a.n", "b.n")), F.least("a.n", "b.n"))
    rest = (
        everyone.alias("a")
        .join(
            outsiders.alias("b"),
            (F.col("a.bucket") == F.col("b.bucket"))
            & (F.col("a.i") == F.col("b.i"))
            & (F.col("a.j") == F.col("b.j"))
            & (F.col("a.component") != F.col("b.component"))
            & ((F.col("a.component") == F.col("a.main")) | (F.col("a.id") < F.col("b.id")))
            & (F.col("a.id") != F.col("a.hub"))
            & (F.col("b.id") != F.col("b.hub"))
            & (100 * possible >= percent * (F.col("a.n") + F.col("b.n") - possible))
            & (apart("a", "b") <= most)
            & (F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.bucket")),  # one of their buckets answers for a pair
        )
        .select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v"))
        .distinct()
    )
    more = cut_lineage(_confirm(cut_lineage(rest), texts, words, percent))
    links = tested.where("linked").select("u", "v").union(more.where("linked").select("u", "v"))
    final = components(links)
    degree = links.select(F.col("u").alias("id")).union(links.select(F.col("v").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    known = (
        classes.select("digest", F.col("id").alias("class_id"))
        .join(final.withColumnRenamed("id", "class_id"), "class_id", "left")
        .join(degree.withColumnRenamed("id", "class_id"), "class_id", "left")
    )
    return (
        signed.select("id", "n_shingles", "digest")
        .join(known, "digest", "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            F.coalesce("component", "class_id", "id").alias("component_id"),
            (F.col("id").isNull() | (F.col("id") == F.coalesce("component", "class_id", "id"))).alias("kept"),
            F.coalesce("class_id", "id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    )
