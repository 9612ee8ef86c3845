"""Words of texts as number arrays, for the functions that run in Arrow batches.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r; A-Z can be lower-cased first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators of words; the pattern of a run of them in Java, Python and RE2.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def bounded(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one take about `most_bytes`; a longer text is a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def compact(texts: pa.Array) -> pa.Array:
    """The same strings as an array of its own, in 64-bit offsets; a null is empty. Some Arrow functions misread slices of large arrays."""
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        raise TypeError(f"strings are needed, not {texts.type}")
    valid, ends, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if ends is not None and n else np.zeros(n + 1, np.int64)
    letters = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if texts.null_count:  # whatever lies under a null goes
        sizes = np.diff(offsets)
        known = texts.is_valid().to_numpy(False)
        letters = letters[np.repeat(known, sizes)]
        offsets = np.concatenate([[0], np.cumsum(np.where(known, sizes, 0))])
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])


def words_of(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(id of each word, the distinct words as bytes, offset of each text's first word). A null has no words."""
    texts = compact(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    coded = flat.dictionary_encode()
    ids, vocabulary = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary())
    offsets = offsets - offsets[0]
    blank = pc.index(vocabulary, pa.scalar(b"", pa.large_binary())).as_py()
    if blank >= 0:  # white space at either end gives an empty piece
        full = ids != blank
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        ids = ids[full]
    return ids, vocabulary, offsets


def hashed_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, offsets)."""
    ids, vocabulary, offsets = words_of(texts, lower)
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter(map(digest, vocabulary.to_numpy(zero_copy_only=False)), np.uint64, len(vocabulary))
    return (table[ids] if len(ids) else np.empty(0, np.uint64)), offsets


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def run_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` consecutive symbols, across whole array; equal runs have equal hashes."""
    n = len(symbols) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, result, done = symbols, None, 0
    size = 1
    while True:  # doubling: the hash of 2^k symbols from two of 2^(k-1)
        if length & size:
            piece = power[done : done + n]
            result = mix(piece) if result is None else mix(result * np.uint64(0x9E3779B97F4A7C15) + piece)
            done += size
        if done == length:
            return result
        power = mix(power[:-size] * np.uint64(0xC2B2AE3D27D4EB4F) + power[size:])
        size *= 2


def column_words(text: Column) -> Column:
    """Array of the words of a text column; none for a null or blank text. Native."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
