"""Anchors: the places by which equal windows of texts find each other without being compared in pairs.

Every window of `width` consecutive symbols has one anchor: of the `gram`-symbol runs inside it, the one of the
smallest hash, the leftmost of equal ones. It depends on the window's content alone, so equal windows have equal
anchors at equal offsets. Consecutive windows mostly share theirs, about 2 / (width - gram + 2) anchors a symbol.
"""

from __future__ import annotations

import numpy as np


def sliding_minimum(values: np.ndarray, length: int) -> np.ndarray:
    """Minimum of every run of `length` values, by doubling."""
    size, current = 1, values
    while 2 * size <= length:
        current = np.minimum(current[:-size], current[size:])
        size *= 2
    rest = length - size
    return current if not rest else np.minimum(current[: len(current) - rest], current[rest:])


def anchor_runs(grams: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor place, first window, last window) of each run of windows of a text that share their anchor.

    grams: well mixed hash of the run of `gram` symbols at each place of the joined texts; offsets: where each text begins.
    Places and windows are places in the joined texts.
    """
    none = np.empty(0, np.int64)
    lengths = np.diff(offsets)
    windows = np.maximum(lengths - width + 1, 0)
    if not windows.sum():
        return none, none, none, none
    order = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_minimum(order, width - gram + 1)
    text = np.repeat(np.arange(len(lengths)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[:-1][text]
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(text)) - 1
    return text[begin], place[begin], start[begin], start[end]


def covered(starts: np.ndarray, width: int, length: int) -> np.ndarray:
    """Mask of the places in [0, length) inside a window that begins at one of `starts`."""
    change = np.zeros(length + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, length), -1)
    return np.cumsum(change[:-1]) > 0
