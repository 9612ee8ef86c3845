"""Best-fit packing by bin completion.

Bins are sequences of `capacity` tokens. A document is its ids and an end id; a longer one is cut into full pieces, of which the
first may be shorter. What decides a packing is how many pieces there are of each length, so the search runs on that
histogram, of at most `capacity` counts, however many documents there are: it gives patterns (lengths that share a
bin, and how many bins do), and the pieces are dealt to the places of the patterns by their number among those of their length.

The search (`complete`) is bin completion. The largest length left opens a bin; its fillings are enumerated from the lengths that are
left, without those another one dominates (its lengths hold the same ones, or sums of them, in less room). A filling is
used for as many bins as the counts allow. Branches are pruned where the waste so far, with the waste that the rest must
have, leaves no bin to save against the incumbent; the first incumbent is the best-fit descent, and the search ends at the lower bound,
or after NODES nodes with the best packing so far, which then need not be the best there is.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrain.llm.chunkids import byte_chunks, chunk_ids
from matchgrain.llm.tables import stored
from matchgrain.llm.textcore import bounded
from matchgrain.operators.ordered import prior_totals

#: Nodes of the search at most, fillings looked at in one node, lengths of one filling beside the largest; nodes between two best-fit descents.
NODES, WIDTH, DEPTH, DESCEND = 4000, 16, 6, 20
#: Rows of the table of places that are broadcast at most; more are joined.
FEW_PLACES = 200_000
#: Pieces of one length are numbered in cells of about this many.
CELL = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

Pattern = tuple[tuple[int, ...], int]  # lengths of a bin in descending order, number of such bins


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A bound: for every p up to half, bins of lengths over capacity - p and over half, and what of the lengths from p to half these cannot take."""
    k = np.zeros(capacity + 1, np.int64)
    for n, number in counts.items():
        k[n] = number
    size = np.arange(capacity + 1)
    half = capacity // 2
    number, length = np.cumsum(k), np.cumsum(k * size)
    p = np.arange(1, half + 1)
    upper = capacity - p
    large = number[capacity] - number[half]
    room = capacity * (number[upper] - number[half]) - (length[upper] - length[half])
    rest = length[half] - length[p - 1]
    more = np.maximum(0, -(-(rest - room) // capacity)).max(initial=0)
    return int(max(-(-length[capacity] // capacity), large + more))


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the lengths of b fit into places as long as those of a; then a can stand for b in any packing."""
    if not b:
        return True
    rooms, first, rest = list(a), b[0], b[1:]
    for k, room in enumerate(rooms):
        if room >= first and room not in rooms[:k]:
            left = room - first
            if dominates(tuple(sorted([*rooms[:k], *rooms[k + 1 :], *([left] if left else [])], reverse=True)), rest):
                return True
    return False


def fillings(counts: dict[int, int], room: int, waste: int) -> list[tuple[int, ...]]:
    """Undominated sets of the lengths left that fill `room` but for `waste` at most; least waste first, then the longest lengths."""
    lengths = sorted((n for n in counts if n <= room), reverse=True)
    found: list[tuple[int, ...]] = []
    tried = 0

    def extend(at: int, chosen: tuple[int, ...], left: int) -> None:
        nonlocal tried
        tried += 1
        if left <= waste and (not lengths or left < lengths[-1] or len(chosen) == DEPTH or left == 0):
            found.append(chosen)
        if left == 0 or len(chosen) == DEPTH:
            return
        low = int(np.searchsorted(-np.array(lengths[at:]), -left)) + at if lengths[at:] else at
        for k in range(low, len(lengths)):
            n = lengths[k]
            if (DEPTH - len(chosen)) * n < left - waste or tried > 40 * WIDTH or len(found) >= 4 * WIDTH:
                break  # shorter ones cannot fill it
            if chosen.count(n) < counts[n]:
                extend(k, (*chosen, n), left - n)

    extend(0, (), room)
    found.sort(key=lambda f: (room - sum(f), [-n for n in f]))
    kept: list[tuple[int, ...]] = []
    for f in found:
        if len(kept) == WIDTH:
            break
        if not any(sum(k) >= sum(f) and dominates(k, f) for k in kept):
            kept.append(f)
    return kept


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Lengths in descending order, each into the fullest bins that take it; equal bins are one entry with a number."""
    bins: dict[int, list[list]] = {}  # by room left: [lengths, number]
    rooms: list[int] = []


    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            k = bisect_left(rooms, n)
            if k == len(rooms):
                each = capacity // n
                for take, number in ((each, left // each), (left % each, 1)):
                    if take and number:
                        _add(bins, rooms, capacity - take * n, (n,) * take, number)
                left = 0
                continue
            room = rooms[k]
            entry = bins[room][-1]
            each = min(room // n, left)
            number = min(entry[1], left // each)
            entry[1] -= number
            if not entry[1]:
                bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(k)
            _add(bins, rooms, room - each * n, (*entry[0], *(n,) * each), number)
            left -= each * number
    return [(tuple(lengths), number) for room in sorted(bins) for lengths, number in bins[room]]


def _add(bins, rooms, room, lengths, number) -> None:


    if room not in bins:
        bins[room] = []
        insort(rooms, room)
    bins[room].append([lengths, number])


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> tuple[list[Pattern], int]:
    """(patterns, lower bound) of a packing of `counts` (length: pieces) into as few bins as the search finds."""
    counts = {n: k for n, k in counts.items() if k}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"pieces need 1 to {capacity} tokens")
    done: list[Pattern] = []
    if capacity in counts:
        done.append(((capacity,), counts.pop(capacity)))
    bound = least_bins(counts, capacity) if counts else 0
    total = sum(n * k for n, k in counts.items())
    best = best_fit(counts, capacity)
    size = sum(k for _, k in best)
    visited = 0

    # Depth first, with an explicit stack: (counts left, patterns so far, bins so far, fillings not yet tried, largest).
    def options(left: dict[int, int], bins: int):
        largest = max(left)
        slack = (size - 1) * capacity - total  # waste that a better packing may have
        wasted = bins * capacity - (total - sum(n * k for n, k in left.items()))
        if wasted > slack or bins + least_bins(left, capacity) >= size:
            return largest, iter(())
        rest = {**left, largest: left[largest] - 1}
        rest = {n: k for n, k in rest.items() if k}
        return largest, iter(fillings(rest, capacity - largest, min(slack - wasted, capacity - largest)))

    stack = [(counts, [], 0, *options(counts, 0))] if counts and size > bound else []
    while stack and visited < nodes and size > bound:
        left, patterns, bins, largest, ways = stack[-1]
        way = next(ways, None)
        if way is None:
            stack.pop()
            continue
        visited += 1
        pattern = (largest, *way)
        copies = min(left[n] // pattern.count(n) for n in set(pattern))
        after = dict(left)
        for n in pattern:
            after[n] -= copies
        after = {n: k for n, k in after.items() if k}
        now, used = [*patterns, (pattern, copies)], bins + copies
        if not after:
            if used < size:
                best, size = now, used
            continue
        descent = best_fit(after, capacity) if visited % DESCEND == 1 else [((capacity,), size)]  # any branch may end as best fit does
        if (tail := used + sum(k for _, k in descent)) < size:
            best, size = [*now, *descent], tail
        stack.append((after, now, used, *options(after, used)))
    return [*done, *best], bound + sum(k for _, k in done)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int):
    encoder = chunk_ids(path, byte_chunks)
    for batch in bounded(batches, "text", 8 << 20):
        ids, offsets = encoder.encoded_with_end(batch.column(1), end)
        sizes = np.diff(offsets)
        numbers = -(-sizes // capacity)
        row = np.repeat(np.arange(len(sizes)), numbers)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
        first = sizes - (numbers - 1) * capacity  # the first piece takes what is over
        start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
        length = np.where(piece == 0, first[row], capacity)
        data, at = np.ascontiguousarray(ids, "<u4").view(np.uint8), 4 * (offsets[row] + start)
        crcs = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces(docs: DataFrame, path: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row of `docs` (doc_id, text), without a shuffle.

    ids: those of the `tokenizers` library for the byte-level file at `path`, and `end`. A null or empty text is the end id alone.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(lambda b: _pieces(b, path, end, capacity), PIECES)


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, number after the last, sequence of the first, offset): the places of the pieces of a length, in order."""
    out, taken, base = [], {}, 0
    for lengths, copies in patterns:
        offset = 0
        for n in lengths:
            low = taken.get(n, 0)
            out.append((n, low, low + copies, base, offset))
            taken[n], offset = low + copies, offset + n
        base += copies
    return out


def pack(docs: DataFrame, path: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all pieces of `docs`, in sequences of at most `capacity` tokens.

    Every row of `docs` is a document of its own, repeated rows and rows without a doc_id too; a null or empty text is its end id.
    A very long text becomes many full pieces. Ties between pieces of one length go by a hash of (doc_id, piece, ids), so that a length
    that a third of all pieces have is numbered in many cells. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, path, end, capacity), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    patterns, _ = complete(counts, capacity)
    rows = places(patterns)
    table = spark.createDataFrame(rows or [(1, 0, 0, 0, 0)], "length long, low long, high long, first long, offset long")
    cells = 1 + max(counts.values(), default=0) // CELL
    h = F.xxhash64("doc_id", "piece", "ids_crc32")
    keyed = cut.withColumn("_h", h).withColumn("_p", F.coalesce("doc_id", F.lit(0)))
    bucket = F.floor((F.col("_h") / F.lit(float(1 << 63)) + 1.0) * (cells / 2.0)).cast("bigint")
    numbered = prior_totals(keyed, ["length"], ["_h", "_p", "piece", "ids_crc32"], bucket, position="_at")
    dealt = numbered.join(F.broadcast(table) if len(rows) <= FEW_PLACES else table, "length").where("_at > low and _at <= high")
    return dealt.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("_at") - 1 - F.col("low")).alias("sequence_id"), "offset")


def _piece_ids(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int):
    encoder = chunk_ids(path, byte_chunks)
    for batch in bounded(batches, "text", 8 << 20):
        ids, offsets = encoder.encoded_with_end(batch.column(1), end)
        sizes = np.diff(offsets)
        numbers = -(-sizes // capacity)
        row = np.repeat(np.arange(len(sizes)), numbers)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
        first = sizes - (numbers - 1) * capacity
        start = offsets[row] + np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(start, len(ids)).astype(np.int32)), pa.array(ids))],
            ["doc_id", "piece", "ids"],
        )


def sequences(docs: DataFrame, placed: DataFrame, path: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """(sequence_id, ids array<int>, doc_ids, lengths): the packed sequences themselves, from `docs` and the rows of `pack`.

    For documents with distinct doc_ids; a sequence has at most `capacity` ids.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    found = rows.mapInArrow(lambda b: _piece_ids(b, path, end, capacity), "doc_id long, piece int, ids array<int>")
    of = placed.select(F.col("doc_id").alias("_d"), F.col("piece").alias("_k"), "sequence_id", "offset", "length")
    joined = found.join(of, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("piece") == F.col("_k")))
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return joined.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.flatten("_p.ids").alias("ids"), F.col("_p.doc_id").alias("doc_ids"), F.col("_p.length").alias("lengths")
    )
