"""Benchmark items in documents, by SimHash fingerprints of item-sized windows.

Words are runs of letters, marks and digits, lower-cased (sharp s as ss, final sigma as sigma); punctuation does not count. An item
of n words is compared with the windows of n words of every document (the whole document, if it is shorter). Shingles are 3 words
(all words of a shorter item); a shingle weighs the letters of its words, times the number of its occurrences. An item that has LONG words at
least is found at a similarity of THRESHOLD, a shorter one at SHORT_THRESHOLD. Of items of HALVED words at least the first, the middle and the
last half are looked for as well, at HALF_THRESHOLD, so an excerpt of half an item is found wherever it is cut. Steps, for one
batch of documents at a time and without a shuffle:
1. Windows that share no shingle with an item have similarity 0. The hashes of the items' shingles (a block of items,
   broadcast) mark the shingles of the documents; only windows whose marks of an item weigh as much as its threshold asks for go on.
2. Each of these windows gets a SimHash of 512 bits: the signs of the weighted sums of its shingles' bits.
3. Multi-index Hamming search: fingerprints are cut into 64 blocks of 8 bits; an item is looked up if some block
   differs in at most 3 bits. Two fingerprints within 233 bits always have such a block (64 * 4 > 233).
4. Items within the radius are verified: sum of minima over sum of maxima of the shingle weights.
At a similarity of 0.35 with equal weights, fingerprints differ in 167 bits on average, with a standard deviation of 11. Where the
difference lies in heavier shingles more bits differ. So fingerprints decide only if item and window are even: no shingle weighs more
than EVEN times the mean shingle (weighted by itself), and the effective number of shingles, (sum)^2 / sum of squares, is MANY at least,
as a few heavy ones may cancel. At that limit 189 bits differ at most on average, and the radius is four deviations away.
Any other item or window is verified with all items (or windows) it shares a shingle with.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrain.llm.textcore import bounded, compact, mix, run_hashes, words_of

WORDS = 3
THRESHOLD, LONG, SHORT_THRESHOLD = 0.35, 10, 0.8
HALF_THRESHOLD, HALVED = 0.5, 20
BITS, BLOCK_BITS, RADIUS, FLIPS = 512, 8, 233, 3
EVEN, MANY = 1.25, 16
#: Bytes of item texts, and of their index, that are broadcast at once; more items take more passes over the documents.
BLOCK_BYTES, INDEX_BYTES, ITEM_BYTES = 8 << 20, 32 << 20, 12 << 10
FILTER_BITS = 20


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its letters in bytes, offsets)."""
    texts = pc.utf8_lower(compact(texts))
    for old, new in (("ß", "ss"), ("ς", "σ")):
        texts = pc.replace_substring(texts, old, new)
    ids, vocabulary, offsets = words_of(pc.replace_substring_regex(texts, r"[^\p{L}\p{M}\p{N}]+", " "), lower=False)
    words = vocabulary.to_numpy(zero_copy_only=False).tolist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    letters = np.fromiter((len(w) for w in words), np.int64, len(words))
    return (table[ids], letters[ids], offsets) if len(ids) else (np.empty(0, np.uint64), np.empty(0, np.int64), offsets)


def _shingles(hashes: np.ndarray, letters: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and weights at every place."""
    sums = np.concatenate([[0], np.cumsum(letters)])
    return run_hashes(hashes, words) + np.uint64(words), sums[words:] - sums[:-words]


def fingerprints(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SimHash (rows of BITS / 8 bytes) of windows given as rows of shingles and their weights."""
    out = np.empty((len(shingles), BITS), bool)
    total = weights.sum(1)
    for word in range(BITS // 64):
        mixed = mix(shingles + np.uint64((word + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        for bit in range(64):
            ones = (((mixed >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) * weights).sum(1)
            out[:, 64 * word + bit] = 2 * ones > total
    return np.packbits(out, axis=1)


def even(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each window, given as rows of shingles and their weights: no shingle occurs twice, none weighs much more than the rest, and a few do not outweigh it."""
    ordered = np.sort(shingles, axis=1)
    twice = (ordered[:, 1:] == ordered[:, :-1]).any(1)
    total, squares = weights.sum(1), (weights * weights).sum(1)
    return ~twice & (weights.max(1) * total <= EVEN * squares) & (total * total >= MANY * squares)


@dataclass
class Items:
    """Index of a block of items; a half of an item is an entry of its own."""

    ids: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)  # words
    limit: list[float] = field(default_factory=list)  # least similarity
    bags: list[dict[int, int]] = field(default_factory=list)  # shingle: occurrences * letters
    even: list[bool] = field(default_factory=list)
    need: np.ndarray = field(default_factory=lambda: np.empty(0))  # least weight of marks
    marks: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)  # by shingle words: filter; shingles, first holder of each, holders
    groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # by size: entries, fingerprints, near ones by block and value, as bits


def parts_of(n: int, threshold: float) -> list[tuple[int, int, float]]:
    """(first word, end, least similarity) of what is looked for of an item of n words."""
    parts = [(0, n, threshold if n >= LONG else max(threshold, SHORT_THRESHOLD))]
    if n >= HALVED:
        half = n // 2
        parts += [(at, at + half, max(threshold, HALF_THRESHOLD)) for at in (0, (n - half) // 2, n - half)]
    return parts


def build_items(rows: list[tuple[int, str]], threshold: float = THRESHOLD) -> Items:
    index = Items()
    holders: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    prints: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    for item, text in rows:
        every, all_letters, _ = _hashed(pa.array([text], pa.string()))
        for low, high, limit in parts_of(len(every), threshold) if len(every) else ():
            hashes, letters = every[low:high], all_letters[low:high]
            words = min(WORDS, len(hashes))
            shingles, weights = _shingles(hashes, letters, words)
            at = len(index.ids)
            index.ids.append(item), index.size.append(len(hashes)), index.limit.append(limit)
            bag: Counter = Counter()
            for s, w in zip(shingles.tolist(), weights.tolist()):
                bag[s] += w
            index.bags.append(dict(bag))
            index.even.append(bool(even(shingles[None, :], weights[None, :])[0]))
            for s in bag:
                holders[words][s].append(at)
            prints[len(hashes)].append((at, fingerprints(shingles[None, :], weights[None, :])[0]))
    index.need = np.array([limit * sum(bag.values()) - 1e-6 for limit, bag in zip(index.limit, index.bags)])
    for words, of in holders.items():
        shingles = np.sort(np.fromiter(of, np.uint64, len(of)))
        filter_ = np.zeros(1 << FILTER_BITS, bool)
        filter_[(shingles >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        lists = [of[s] for s in shingles.tolist()]
        index.marks[words] = (filter_, shingles, np.cumsum([0, *map(len, lists)]), np.array([i for x in lists for i in x]))
    flips = np.array([f for f in range(1 << BLOCK_BITS) if f.bit_count() <= FLIPS], np.uint8)
    for size, pairs in prints.items():
        codes = np.stack([p for _, p in pairs])
        near = np.zeros((BITS // BLOCK_BITS, 1 << BLOCK_BITS, len(pairs)), bool)
        for block in range(BITS // BLOCK_BITS):
            near[block, codes[:, block][None, :] ^ flips[:, None], np.arange(len(pairs))[None, :]] = True
        index.groups[size] = (np.array([a for a, _ in pairs]), codes, np.packbits(near, axis=2))
    return index


def _similarity(window: dict[int, int], item: dict[int, int]) -> float:
    low = sum(min(w, item[s]) for s, w in window.items() if s in item)
    return low / (sum(window.values()) + sum(item.values()) - low)


def _windows(texts_offsets: np.ndarray, shingles: np.ndarray, weights: np.ndarray, words: int, index: Items) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(row, first word) of the windows that marks leave, by (words of the entry, words of the window)."""
    filter_, known, firsts, holders = index.marks[words]
    at = np.flatnonzero(filter_[(shingles >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    rows = np.searchsorted(texts_offsets, at, "right") - 1
    place = np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)
    real = (known[place] == shingles[at]) & (at + words <= texts_offsets[rows + 1])
    at, rows, place = at[real], rows[real], place[real]
    number = firsts[place + 1] - firsts[place]
    entry = holders[np.arange(number.sum()) + np.repeat(firsts[place] - (np.cumsum(number) - number), number)]
    at, pair = np.repeat(at, number), np.repeat(rows, number) * len(index.ids) + entry
    order = np.argsort(pair, kind="stable")  # places ascend within a pair
    at, pair = at[order], pair[order]
    edges = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
    ends = np.append(edges[1:], len(pair))
    heavy = np.add.reduceat(weights[at], edges) >= index.need[pair[edges] % len(index.ids)] if len(edges) else np.empty(0, bool)
    found: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
    for a, b in zip(edges[heavy].tolist(), ends[heavy].tolist()):
        row, item = divmod(int(pair[a]), len(index.ids))
        size = index.size[item]
        lowest, length = int(texts_offsets[row]), int(texts_offsets[row + 1] - texts_offsets[row])
        span = min(size, length)
        p = at[a:b]
        sums = np.append(0, np.cumsum(weights[p]))
        starts = np.unique((p[:, None] - np.arange(span - words + 1)).ravel())
        starts = starts[(starts >= lowest) & (starts <= lowest + length - span)]
        marked = sums[np.searchsorted(p, starts + span - words, "right")] - sums[np.searchsorted(p, starts)]
        found[size, span].update((row, s) for s in starts[marked >= index.need[item]].tolist())
    return {key: sorted(windows) for key, windows in found.items()}


def find_items(texts: pa.Array, index: Items) -> list[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, words) of the best window of each row and item that is at the item's threshold or above."""
    hashes, letters, offsets = _hashed(texts)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for words, (_, known, firsts, holders) in index.marks.items():
        if len(hashes) < words:
            continue
        shingles, weights = _shingles(hashes, letters, words)
        for (size, span), pairs in _windows(offsets, shingles, weights, words, index).items():
            entries, codes, near = index.groups[size]
            number = {int(e): k for k, e in enumerate(entries)}
            odd = not all(index.even[e] for e in number)
            for base in range(0, len(pairs), 2048):
                part = pairs[base : base + 2048]
                place = np.array([s for _, s in part])[:, None] + np.arange(span - words + 1)
                prints = fingerprints(shingles[place], weights[place])
                close = np.zeros((len(part), near.shape[2]), np.uint8)
                for block in range(BITS // BLOCK_BITS):
                    close |= near[block, prints[:, block]]
                w, k = np.nonzero(np.unpackbits(close, axis=1, count=len(entries)))
                within = np.bitwise_count(prints[w] ^ codes[k]).sum(1) <= RADIUS
                candidates = set(zip(w[within].tolist(), k[within].tolist()))
                level = even(shingles[place], weights[place])
                for w in range(len(part)) if odd else np.flatnonzero(~level).tolist():
                    row_shingles = shingles[place[w]]
                    spot = np.minimum(np.searchsorted(known, row_shingles), len(known) - 1)
                    for x in np.unique(spot[known[spot] == row_shingles]).tolist():
                        for e in holders[firsts[x] : firsts[x + 1]].tolist():
                            if index.size[e] == size and not (level[w] and index.even[e]):
                                candidates.add((w, number[e]))
                for w, k in candidates:
                    bag: Counter = Counter()
                    for s, x in zip(shingles[place[w]].tolist(), weights[place[w]].tolist()):
                        bag[s] += x
                    e = int(entries[k])
                    found = _similarity(bag, index.bags[e])
                    row, start = part[w]
                    entry = (found, -(start - int(offsets[row])), span)
                    if found >= index.limit[e] and entry > best.get((row, index.ids[e]), (0.0, 0, 0)):
                        best[row, index.ids[e]] = entry
    return [(row, item, found, -start, span) for (row, item), (found, start, span) in sorted(best.items())]


def _blocks(benchmark: DataFrame, threshold: float) -> Iterator:
    """Broadcast indexes of the items, a block of at most about BLOCK_BYTES of text and INDEX_BYTES of index at a time."""
    spark = benchmark.sparkSession
    items = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("text is not null").distinct()
    total, number = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(-(-total // BLOCK_BYTES), -(-number * ITEM_BYTES // INDEX_BYTES))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        yield spark.sparkContext.broadcast(build_items([(r.item_id, r.text) for r in part.collect()], threshold))


def _hits(batches: Iterator[pa.RecordBatch], shared):
    for batch in bounded(batches, "text", 4 << 20):
        found = find_items(batch.column(1), shared.value)
        rows = pa.array([f[0] for f in found], pa.int64())
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds, 1)]],
            ["doc_id", "item_id", "similarity", "first_word", "n_words"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window for each document and item it contains, or contains half of.

    `docs` has doc_id and text, `benchmark` item_id and text. Texts without words, null ones too, contain nothing and
    are contained in nothing; a row without a doc_id gives rows without one; a repeated row of `docs` gives its rows again,
    repeated items count once. Ties go to the first window. Without items the result is empty. Other columns are ignored.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    found = None
    for shared in _blocks(benchmark, threshold):
        part = rows.mapInArrow(lambda b, s=shared: _hits(b, s), schema)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _clean(batches: Iterator[pa.RecordBatch], shared):
    for batch in bounded(batches, "text", 4 << 20):
        text = batch.column(batch.schema.get_field_index("text"))
        hit = np.zeros(batch.num_rows, bool)
        hit[[f[0] for f in find_items(text, shared.value)]] = True
        yield batch.filter(pa.array(~hit))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, that contain no benchmark item; rules as in `contaminated`."""
    for shared in _blocks(benchmark, threshold):
        docs = docs.mapInArrow(lambda b, s=shared: _clean(b, s), docs.schema)
    return docs
