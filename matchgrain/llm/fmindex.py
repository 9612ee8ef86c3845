"""Passages that occur in an earlier document, by FM-indexes over shards of text.

Texts are routed to shards by content, so that equal windows of `window` words always meet in one shard:
a window's route is the hash of its anchor (see `anchors`), and consecutive windows with one anchor travel as one segment.
Only anchors that occur in two different texts are routed; a window whose anchor occurs in one text is in no other.
A shard keeps its distinct segments, each with the smallest doc_id that holds it, as an FM-index: the Burrows-Wheeler
transform of the word sequence in a wavelet matrix. Each window of the segments then goes through a backward search of
its own, and its interval of suffixes gives the smallest doc_id that holds it. The index is not compressed, and no other match lengths are computed.
An anchor with more than `busy` occurrences routes each of its windows by itself, by the hash of the whole window,
so what surrounds a very common passage is spread over the shards, and equal windows are one row before they get there.
Documents with equal texts are one text: the smallest doc_id stands for it, the others lose every window they have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.storage import cut_lineage
from matchgrain.llm.anchors import anchor_runs, covered
from matchgrain.llm.textcore import bounded, hashed_words, mix, run_hashes, words_of

GRAM = 4
#: Symbols of an index at which a task begins the next one.
SHARD = 400_000


class FmIndex:
    """Backward search over a sequence of symbols 1, 2, ... (0 separates segments), up to `depth` symbols deep."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        rank, known = symbols.astype(np.int64), 1
        while known < depth:  # order of suffixes by their first `known` symbols
            ahead = np.zeros(n, np.int64)
            ahead[: n - known] = rank[known:] + 1
            key = rank * (n + 2 if known > 1 else int(symbols.max()) + 2) + ahead
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            known *= 2
        self.order = order if depth > 1 else np.argsort(symbols, kind="stable")
        row = symbols[self.order - 1]  # the transform
        kinds = int(symbols.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=kinds))])
        self.levels = max(1, (kinds - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.base = self._descend(np.arange(kinds), np.zeros(kinds, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            ones = self.ones[k][place]
            place = np.where((symbol >> level) & 1, self.zeros[k] + ones, place - ones)
        return place

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes after `symbol` is put before the patterns with intervals [low, high)."""
        first, base = self.before[symbol], self.base[symbol]
        return first + self._descend(symbol, low) - base, first + self._descend(symbol, high) - base


def earliest_holders(segments: list[np.ndarray], holders: np.ndarray, window: int) -> list[np.ndarray]:
    """For every window of every segment the smallest holder among all segments with that window."""
    sizes = np.array([len(s) for s in segments])
    _, coded = np.unique(np.concatenate(segments), return_inverse=True)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(len(coded)) + owner] = coded + 1
    index = FmIndex(text, window)
    counts = sizes - window + 1
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(text))
    for k in reversed(range(window)):
        low, high = index.extend(text[at + k], low, high)
    if (high <= low).any():
        raise AssertionError("a window of the index was not found in it")
    held = np.repeat(np.append(holders, 0), np.append(sizes + 1, 0))[index.order]
    lows, first = np.unique(low, return_index=True)
    edges = np.stack([lows, high[first]], 1).ravel()
    least = np.minimum.reduceat(np.append(held, np.iinfo(np.int64).max), edges)[::2]
    return np.split(least[np.searchsorted(lows, low)], np.cumsum(counts)[:-1])


def _grams(texts: pa.Array, window: int):
    hashes, offsets = hashed_words(texts, lower=False)
    grams = run_hashes(hashes, GRAM)
    return hashes, offsets, grams, anchor_runs(grams, offsets, window, GRAM)


def _anchors(batches: Iterator[pa.RecordBatch], window: int):
    for batch in bounded(batches, "text"):
        _, offsets, grams, (text, place, _, _) = _grams(batch.column(1), window)
        columns = [pa.array(grams[place].view(np.int64)), batch.column(0).take(pa.array(text)), pa.array((place - offsets[:-1][text]).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "text_key", "at"])


def _segments(batches: Iterator[pa.RecordBatch], window: int, words: bool):
    """Segments of the marked anchors of each text; with their words, or where they begin."""
    for batch in bounded(batches, "text"):
        hashes, offsets, grams, (text, place, first, last) = _grams(batch.column(2), window)
        marks = batch.column(3)
        busy_marks = batch.column(4)
        row_of = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(marks), 0).to_numpy(False))
        flat = pc.list_flatten(marks).to_numpy(False).astype(np.int64) + offsets[:-1][row_of] if len(row_of) else np.empty(0, np.int64)
        busy_row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(busy_marks), 0).to_numpy(False))
        busy = pc.list_flatten(busy_marks).to_numpy(False).astype(np.int64) + offsets[:-1][busy_row] if len(busy_row) else np.empty(0, np.int64)
        whole = np.isin(place, flat)
        single = np.isin(place, busy)
        routes, starts, ends, rows = [grams[place[whole]]], [first[whole]], [last[whole] + window], [text[whole]]
        if single.any():
            n = last[single] - first[single] + 1
            begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[single], n)
            routes.append(mix(run_hashes(hashes, window)[begin]))
            starts.append(begin), ends.append(begin + window), rows.append(np.repeat(text[single], n))
        route, start, end, row = (np.concatenate(x) for x in (routes, starts, ends, rows))
        if not len(route):
            continue
        raw = hashes.tobytes()
        content = [raw[8 * a : 8 * b] for a, b in zip(start.tolist(), end.tolist())]
        digest = np.fromiter((xxhash.xxh3_64_intdigest(c) for c in content), np.uint64, len(content)).view(np.int64)
        at = pa.array(row)
        columns = [pa.array(route.view(np.int64)), pa.array(digest), batch.column(0).take(at)]
        if words:
            yield pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.binary())], ["route", "digest", "doc_id", "words"])
        else:
            columns += [batch.column(1).take(at), pa.array((start - offsets[:-1][row]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["route", "digest", "doc_id", "text_key", "first"])


def _search(batches: Iterator[pa.RecordBatch], window: int):
    """Rows (route, digest, words, holder) in order of route: an index for every SHARD symbols, cut between routes."""

    def answer(rows: list[tuple]):
        segments = [np.frombuffer(r[2], np.uint64) for r in rows]
        least = earliest_holders(segments, np.array([r[3] for r in rows], np.int64), window)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(least, pa.list_(pa.int64()))], ["route", "digest", "holders"]
        )

    rows, symbols = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if symbols >= SHARD and row[0] != rows[-1][0]:
                yield answer(rows)
                rows, symbols = [], 0
            rows.append(row)
            symbols += len(row[2]) // 8
    if rows:
        yield answer(rows)


def _finish(batches: Iterator[pa.RecordBatch], window: int, full: bool):
    for batch in bounded(batches, "text"):
        texts = batch.column(1)
        ids, vocabulary, offsets = words_of(texts, lower=False)
        shown = vocabulary.to_numpy(zero_copy_only=False).tolist()
        removed, kept = [], []
        for i, (starts, copy) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            own = ids[offsets[i] : offsets[i + 1]]
            if copy and len(own) >= window:
                gone = np.ones(len(own), bool)
            elif starts:
                gone = covered(np.array(starts, np.int64), window, len(own))
            else:
                gone = np.zeros(len(own), bool)
            removed.append(int(gone.sum()))
            left = b" ".join([shown[w] for w in own[~gone]])
            kept.append(left.decode() if full else hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"]
        )


def remove_earlier_passages(docs: DataFrame, window: int = 13, busy: int = 5000, full: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of `docs` (doc_id, text).

    A word goes if a window of `window` words covers it whose word sequence also begins in a document with a
    smaller doc_id; windows are those of the input. kept: the remaining words joined by one space, or the SHA-256 of
    that (`full=False`). Words are compared as 64-bit hashes. A null, empty or blank text has no words. A row
    without a doc_id loses nothing and takes nothing from others. Repeated rows come out once each and lose the same;
    rows that share a doc_id but not the text take nothing from one another. Other columns are ignored.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) text_key", "cast(text as string) text")
    usable = rows.where("doc_id is not null and text is not null")
    # One shuffle of the places serves their grouping and their join; with both keys known as not null, no filter tells the two apart.
    places = usable.select("text_key", "text").mapInArrow(lambda b: _anchors(b, window), "anchor long, text_key long, at int")
    places = places.where("anchor is not null and text_key is not null").repartition("anchor")
    shared = places.groupBy("anchor").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.count("at").alias("n")).where("a <> b")
    owners = usable.groupBy("text_key").agg(F.min("doc_id").alias("owner"))
    hits = (
        places.join(shared.select("anchor", (F.col("n") > busy).alias("busy")), "anchor")
        .groupBy("text_key")
        .agg(F.collect_set(F.when(~F.col("busy"), F.col("at"))).alias("marks"), F.collect_set(F.when(F.col("busy"), F.col("at"))).alias("busy_marks"))
    )
    known = usable.select("doc_id", "text_key").distinct().join(owners, "text_key").select("doc_id", "text_key", (F.col("doc_id") > F.col("owner")).alias("copy"))
    facts = cut_lineage(known.join(hits, "text_key", "left").select("doc_id", "text_key", "copy", "marks", "busy_marks"))
    marked = (
        usable.join(facts.where("not copy and (size(marks) > 0 or size(busy_marks) > 0)"), ["doc_id", "text_key"])
        .select("doc_id", "text_key", "text", "marks", "busy_marks")
    )
    segments = marked.mapInArrow(lambda b: _segments(b, window, True), "route long, digest long, doc_id long, words binary")
    distinct = segments.groupBy("route", "digest").agg(F.first("words").alias("words"), F.min("doc_id").alias("holder"))
    found = (
        distinct.repartition("route")
        .sortWithinPartitions("route")
        .mapInArrow(lambda b: _search(b, window), "route long, digest long, holders array<long>")
    )
    begun = marked.mapInArrow(lambda b: _segments(b, window, False), "route long, digest long, doc_id long, text_key long, first int")
    earlier = F.filter(F.transform("holders", lambda h, i: F.when(h < F.col("doc_id"), F.col("first") + i)), lambda s: s.isNotNull())
    starts = (
        begun.join(found, ["route", "digest"])
        .select("doc_id", "text_key", earlier.alias("starts"))
        .where(F.size("starts") > 0)
        .groupBy("doc_id", "text_key")
        .agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    )
    verdict = facts.select("doc_id", "text_key", "copy").join(starts, ["doc_id", "text_key"], "left").where("copy or starts is not null")
    # Both joins of texts have `usable` as it stands on one side, so Spark shuffles the texts once.
    judged = usable.join(verdict, ["doc_id", "text_key"], "left").select("doc_id", "text", "starts", "copy")
    others = rows.where("doc_id is null or text is null").select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("boolean").alias("copy"))
    return judged.union(others).mapInArrow(lambda b: _finish(b, window, full), "doc_id long, n_words long, n_removed long, kept string")
