"""Repeated byte strings across and within documents, by suffix arrays of shards.

Texts are routed to shards by content, so that equal strings of `window` bytes meet: a string's route is the hash of
its anchor (see `anchors`), and consecutive strings with one anchor travel as one segment. Only anchors that
occur in two different texts, or twice in one, are routed; any other string is unique. Equal segments are one row
with their number before they reach a shard.

A shard cuts its segments at places chosen by content (local minima of hashes of 8 bytes) and names the pieces by
number. The suffix array of that number sequence (`gsaca`) puts equal stretches side by side. A string of `window` bytes that occurs twice has the
same whole pieces inside both times, so the suffix at its first piece has a neighbour that agrees up to its last piece: windows
without one are unique. The others are compared as 128-bit hashes of all their bytes, which confirms the repeats.

The strings of an anchor with more than `busy` occurrences have a longer anchor, of three quarters of the window, as
their route, which is common only where more of their bytes are. Where a route still has more than `busy` different segments, the shard
passes on each of their strings as the 128-bit hash of its bytes, and equal ones are counted by a grouping; so what surrounds
a very common passage is never one group.
Documents with equal texts are one text; if there are several, all strings of each repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.storage import cut_lineage
from matchgrain.llm.anchors import anchor_runs, sliding_minimum
from matchgrain.llm.gsaca import suffix_array
from matchgrain.llm.textcore import bounded, mix

GRAM = 50
#: Bytes of a text that are looked at together, and bytes of segments at which a task begins the next suffix array.
PIECE, SHARD = 1 << 20, 2 << 20
#: Cutting places of a segment: the least hash of CUT_GRAM bytes among CUT_SPAN neighbours.
CUT_GRAM, CUT_SPAN = 8, 24


def byte_runs(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of `length` bytes: a polynomial modulo 2^64, by doubling."""
    base = (0x9E3779B97F4A7C15 + 2 * 0xC2B2AE3D27D4EB4F * seed) | 1
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    table = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * seed))
    power, size, result, done = table[data], 1, None, 0
    while True:
        if length & size:
            piece = power[done : done + n]
            result = piece if result is None else result * np.uint64(pow(base, size, 1 << 64)) + piece
            done += size
        if done == length:
            return mix(result)
        power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2


def _pieces(batches: Iterator[pa.RecordBatch], column: int, window: int):
    """(batch, row of each piece, its place in the text, joined bytes, offsets): texts in overlapping pieces, about PIECE bytes at a time."""
    for batch in bounded(batches, "text", PIECE):
        rows, bases, parts, total = [], [], [], 0
        for i, text in enumerate(batch.column(column).cast(pa.large_binary()).to_pylist()):
            for base in range(0, max(1, len(text or b"") - window + 1), PIECE):
                part = (text or b"")[base : base + PIECE + window - 1]
                rows.append(i), bases.append(base), parts.append(part)
                total += len(part)
                if total >= PIECE:
                    yield batch, rows, bases, parts
                    rows, bases, parts, total = [], [], [], 0
        if rows:
            yield batch, rows, bases, parts


def _runs(rows: list[int], bases: list[int], parts: list[bytes], window: int):
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    grams = byte_runs(data, GRAM)
    piece, place, first, last = anchor_runs(grams, offsets, window, GRAM)
    shift = np.array(bases, np.int64)[piece] - offsets[:-1][piece]  # from joined places to places in the text
    return data, grams, np.array(rows, np.int64)[piece], place, first, last, shift


def _anchors(batches: Iterator[pa.RecordBatch], window: int):
    """Anchors with their places in the texts; overlapping pieces of a text may give one place twice."""
    for batch, rows, bases, parts in _pieces(batches, 1, window):
        _, grams, row, place, _, _, shift = _runs(rows, bases, parts, window)
        key = pa.array(grams[place].view(np.int64))
        yield pa.RecordBatch.from_arrays([key, batch.column(0).take(pa.array(row)), pa.array((place + shift).astype(np.int64))], ["anchor", "text_key", "at"])


def _longer(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(route, first, last) of the segments by longer anchors that make up the runs of windows first..last."""
    grams = byte_runs(data, 3 * window // 4)
    _, place, begin, _ = anchor_runs(grams, offsets, window, 3 * window // 4)
    n = last - first + 1
    windows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    run = np.searchsorted(begin, windows, "right") - 1
    head = np.flatnonzero(np.append(True, (windows[1:] != windows[:-1] + 1) | (run[1:] != run[:-1])))
    tail = np.append(head[1:], len(windows)) - 1
    return grams[place[run[head]]], windows[head], windows[tail]


def _segments(batches: Iterator[pa.RecordBatch], window: int, content: bool):
    """Segments of the marked anchors: with their bytes, or where they begin."""
    for batch, rows, bases, parts in _pieces(batches, 1, window):
        data, grams, row, place, first, last, shift = _runs(rows, bases, parts, window)
        if not len(place):
            continue
        wanted = sorted(set(rows))
        marked = {name: np.array([(i << 40) + at for i in wanted for at in (batch.column(c)[i].as_py() or ())], np.int64) for name, c in (("marks", 2), ("busy", 3))}
        own = (row << 40) + place + shift
        whole, busy = np.isin(own, marked["marks"]), np.isin(own, marked["busy"])
        route, begin, end = grams[place[whole]], first[whole], last[whole]
        if busy.any():
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            longer = _longer(data, offsets, first[busy], last[busy], window)
            route, begin, end = (np.concatenate(x) for x in zip((route, begin, end), longer))
        if not len(route):
            continue
        raw = data.tobytes()
        bytes_ = [raw[a : b + window] for a, b in zip(begin.tolist(), end.tolist())]
        digest = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in bytes_), np.uint64, len(bytes_))
        columns = [pa.array(route.view(np.int64)), pa.array(digest.view(np.int64))]
        if content:
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bytes_, pa.binary())], ["route", "digest", "bytes"])
        else:
            run = np.searchsorted(first, begin, "right") - 1
            key = batch.column(0).take(pa.array(row[run]))
            yield pa.RecordBatch.from_arrays([*columns, key, pa.array(begin + shift[run])], ["route", "digest", "text_key", "first"])


def repeated_windows(segments: list[bytes], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each distinct segment the windows in it that occur twice or more, where segment i stands for counts[i] places."""
    sizes = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"".join(segments), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    hashes = byte_runs(data, CUT_GRAM)
    order = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    least = (sliding_minimum(order, CUT_SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Cutting places: the least place of each span that lies inside one segment.
    spans = sizes - (CUT_GRAM + CUT_SPAN - 1) + 1
    inside = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(offsets[:-1], spans)
    cuts = np.unique(least[inside])
    owner = np.searchsorted(offsets, cuts, "right") - 1
    # A piece reaches from a cut to the next of its segment; its name is the number of its content.
    after = np.append(cuts[1:], 0)
    closed = np.append(owner[1:] == owner[:-1], False)
    lengths = np.where(closed, after - cuts, 0)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)])  # of the hashes at all places of the piece
    sums = prefix[np.minimum(cuts + lengths, len(hashes))] - prefix[cuts]
    name = mix(mix(hashes[cuts] + lengths.astype(np.uint64)) + sums)
    _, numbers = np.unique(name, return_inverse=True)
    symbols = np.where(closed, numbers + 1, 0)
    array = suffix_array(symbols)
    # Bytes of whole pieces that each suffix shares with its neighbours.
    a, b = array[:-1], array[1:]
    shared, alive, step = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(alive):
        x, y = a[alive] + step, b[alive] + step
        inside_ = (x < len(symbols)) & (y < len(symbols))
        alive, x, y = alive[inside_], x[inside_], y[inside_]
        same = (symbols[x] == symbols[y]) & (symbols[x] > 0) & (shared[alive] < window)
        alive, x = alive[same], x[same]
        shared[alive] += lengths[x]
        step += 1
    best = np.zeros(len(symbols), np.int64)
    np.maximum.at(best, a, shared), np.maximum.at(best, b, shared)
    n = sizes - window + 1
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    segment = np.repeat(np.arange(len(sizes)), n)
    head, tail = least[at], least[at + window - (CUT_GRAM + CUT_SPAN - 1)]
    several = counts[segment] > 1
    open_ = np.flatnonzero((best[np.searchsorted(cuts, head)] >= tail - head) & ~several)
    twin = np.flatnonzero((best[np.searchsorted(cuts, head)] >= tail - head))
    repeated = several.copy()
    if len(open_):
        high, low = byte_runs(data, window)[at[twin]], byte_runs(data, window, 1)[at[twin]]
        by = np.lexsort((low, high))
        equal = (high[by][1:] == high[by][:-1]) & (low[by][1:] == low[by][:-1])
        repeated[twin[by[1:]][equal]] = True
        repeated[twin[by[:-1]][equal]] = True
    edges = np.cumsum(n)[:-1]
    return [np.flatnonzero(r) for r in np.split(repeated, edges)]


def _as_ranges(starts: np.ndarray, window: int) -> list[int]:
    """Flat list begin, end, begin, end, ... of the bytes that windows at sorted `starts` cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] - starts[:-1] > window)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + window], 1).ravel().tolist()


SEARCHED = pa.schema([(c, pa.int64()) for c in ("route", "digest")] + [("ranges", pa.list_(pa.int64()))] + [(c, pa.int64()) for c in ("high", "low", "at", "n")])


def _spread(rows: list[tuple], window: int) -> pa.RecordBatch:
    """Each string of the segments by itself, as the hash of its bytes."""
    sizes = np.array([len(r[2]) for r in rows], np.int64)
    data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    n = sizes - window + 1
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = at + np.repeat(np.cumsum(sizes) - sizes, n)
    facts = [np.repeat(np.array([r[k] for r in rows], np.int64), n) for k in (0, 1, 3)]
    hashes = [byte_runs(data, window, seed)[place].view(np.int64) for seed in (0, 1)]
    return pa.RecordBatch.from_arrays(
        [pa.array(facts[0]), pa.array(facts[1]), pa.nulls(len(at), pa.list_(pa.int64())), *map(pa.array, hashes), pa.array(at), pa.array(facts[2])], schema=SEARCHED
    )


def _search(batches: Iterator[pa.RecordBatch], window: int, busy: int):
    """Rows (route, digest, bytes, n) in order of route: repeated ranges of each segment, or its strings where a route has more than `busy` rows."""

    def answer(rows: list[tuple]):
        found = repeated_windows([r[2] for r in rows], np.array([r[3] for r in rows]), window)
        out = [(r[0], r[1], _as_ranges(f, window)) for r, f in zip(rows, found) if len(f)]
        empty = pa.nulls(len(out), pa.int64())
        columns = [pa.array([o[k] for o in out], SEARCHED.field(k).type) for k in range(3)]
        return pa.RecordBatch.from_arrays([*columns, empty, empty, empty, empty], schema=SEARCHED)

    rows, total, group, spread = [], 0, [], False
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if group and row[0] != group[-1][0]:
                if spread:
                    yield _spread(group, window)
                else:
                    rows += group
                    total += sum(len(r[2]) for r in group)
                group, spread = [], False
                if total >= SHARD:
                    yield answer(rows)
                    rows, total = [], 0
            group.append(row)
            if len(group) > (max(busy, 1) if not spread else 1000):
                yield _spread(group[:-1], window)  # the last one stays, to tell its route
                group, spread = group[-1:], True
    if spread:
        yield _spread(group, window)
    else:
        rows += group
    if rows:
        yield answer(rows)


def _finish(batches: Iterator[pa.RecordBatch], window: int, full: bool):
    for batch in bounded(batches, "text"):
        counts, removed, spans, kept = [], [], [], []
        for text, ranges, several in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            text = text or b""
            if several and len(text) >= window:
                merged = [(0, len(text))]
            else:
                merged = []
                for a, b in sorted(zip(ranges[::2], ranges[1::2])) if ranges else ():
                    if merged and a <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                    else:
                        merged.append((a, b))
            ends = [0, *(x for r in merged for x in r), len(text)]
            left = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
            counts.append(len(text)), spans.append(len(merged)), removed.append(len(text) - len(left))
            kept.append(left if full else hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary() if full else pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, window: int = 200, busy: int = 5000, full: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of `docs` (doc_id, text), texts as UTF-8 bytes.

    A byte goes if a string of `window` bytes covers it that also begins anywhere else in the rows, the same text
    included; strings are those of the input and never cross texts. n_spans counts maximal removed runs. kept: the
    remaining bytes (binary, as a cut may split a character), or their SHA-256 (`full=False`). A null text is empty; texts
    shorter than `window` lose nothing. Each row is a document, repeated rows and rows with a null doc_id too.
    Other columns are ignored.
    """
    if window < GRAM + CUT_GRAM + CUT_SPAN:
        raise ValueError("the window is too short for its anchors")
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) text_key", "cast(text as string) text")
    long_ = rows.where(F.octet_length("text") >= window)
    classes = long_.groupBy("text_key").agg((F.count("*") > 1).alias("several"), F.min("doc_id").alias("owner"))
    # Dealt by anchor once, so neither their grouping nor their join shuffles them again.
    places = long_.select("text_key", "text").mapInArrow(lambda b: _anchors(b, window), "anchor long, text_key long, at long").repartition("anchor")
    # Two places of one text may lie in pieces that no batch holds together, so they are told apart here.
    ends = [f(c).alias(f"{n}_{c}") for c in ("text_key", "at") for n, f in (("min", F.min), ("max", F.max))]
    shared = places.groupBy("anchor").agg(*ends, F.count("*").alias("n")).where("min_text_key <> max_text_key or min_at <> max_at")
    hits = (
        places.join(shared.select("anchor", (F.col("n") > busy).alias("busy")), "anchor")
        .groupBy("text_key")
        .agg(F.collect_set(F.when(~F.col("busy"), F.col("at"))).alias("marks"), F.collect_set(F.when(F.col("busy"), F.col("at"))).alias("busy_marks"))
    )
    facts = cut_lineage(classes.join(hits, "text_key", "left"))
    first = long_.join(facts.where("size(marks) > 0 or size(busy_marks) > 0"), "text_key").where(F.col("doc_id").eqNullSafe(F.col("owner")))
    marked = first.select("text_key", "text", "marks", "busy_marks")
    pieces = marked.mapInArrow(lambda b: _segments(b, window, True), "route long, digest long, bytes binary")
    distinct = pieces.groupBy("route", "digest").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n"))
    searched = cut_lineage(
        distinct.repartition("route")
        .sortWithinPartitions("route")
        .mapInArrow(lambda b: _search(b, window, busy), "route long, digest long, ranges array<long>, high long, low long, at long, n long")
    )
    strings = searched.where("at is not null")
    again = strings.groupBy("high", "low").agg(F.sum("n").alias("n")).where("n > 1").select("high", "low")
    alone = strings.join(again, ["high", "low"]).groupBy("route", "digest").agg(F.flatten(F.collect_list(F.array("at", F.col("at") + window))).alias("ranges"))
    found = searched.where("at is null").select("route", "digest", "ranges").union(alone)
    begun = marked.mapInArrow(lambda b: _segments(b, window, False), "route long, digest long, text_key long, first long")
    ranges = (
        begun.join(found, ["route", "digest"])
        .select("text_key", F.transform("ranges", lambda x: x + F.col("first")).alias("ranges"))
        .groupBy("text_key")
        .agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    )
    verdict = facts.select("text_key", "several").join(ranges, "text_key", "left").where("several or ranges is not null")
    # Both joins of texts have `long_` as it stands on one side, so Spark shuffles the texts once.
    judged = long_.join(verdict, "text_key", "left").select("doc_id", "text", "ranges", "several")
    short = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) < window)
    short = short.select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("ranges"), F.lit(None).cast("boolean").alias("several"))
    return judged.union(short).mapInArrow(
        lambda b: _finish(b, window, full), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'binary' if full else 'string'}"
    )
