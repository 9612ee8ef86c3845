"""Texts of an Arrow batch as one array of bytes, and fixed-size filters of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrain.llm.textcore import compact, mix


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offset of each text); a null is empty."""
    texts = compact(texts)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse: strings that lie one after the other in `data`, which is UTF-8 in each of them."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, mix(hashes + np.uint64(0x9E3779B97F4A7C15)) & mask


class HashFilter:
    """A Bloom filter of 2^k bits and two places a hash. What was put in is always found; little else is."""

    def __init__(self, bits: int):
        self.bits, self.bytes = bits, np.zeros(bits // 8, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in _places(hashes, self.bits):
            found &= (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return found


def _filter_places(batches, bits: int):
    for batch in batches:
        hashes = batch.column(0).to_numpy(False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(hashes, bits)).astype(np.int64))], ["place"])


def hash_filter(hashes: DataFrame, column: str, rows: int, most_bits: int = 1 << 27) -> HashFilter:
    """Filter of the values of a long column without nulls: 16 bits for each of `rows` values, `most_bits` at most.

    The bits are set in the cluster, 4 KB a row, so at most `most_bits` / 8 bytes reach the driver. A full filter
    finds more that was not put in, and misses nothing.
    """
    bits = 1 << 15
    while bits < min(16 * rows, most_bits):
        bits *= 2
    out = HashFilter(bits)
    places = hashes.select(column).mapInArrow(lambda b: _filter_places(b, bits), "place long").select((F.col("place") + 1).alias("place"))
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    for row in parts.collect():
        at = (row.bucket - 1) * 4096
        out.bytes[at : at + 4096] = np.frombuffer(row.bitmap, np.uint8)
    return out
