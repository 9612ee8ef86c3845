"""Suffix array of a number sequence by linear grouping, without recursive renaming.

Phase 1 groups the suffixes by their longest Lyndon prefix. Groups start as the suffixes of one first symbol and are
processed in descending order. For each suffix i of the group, prev(i) is the last suffix before i that lies in a
smaller group; the group's prefix is appended to the prefix of every prev(i), which splits the group of prev(i)
by how often that happens. Pointers prev of larger groups are final, so each search follows them.
Phase 2 goes through the array from the smallest suffix on: once suffix i has its place, i - 1 and the chain of prev
pointers from it, up to one that is placed already, are the suffixes whose Lyndon prefix ends before i; each takes the next
place of its group. Every suffix is placed once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `symbols` (nonnegative numbers) in ascending order; a suffix that is a prefix of another comes first."""
    n = len(symbols) + 1
    text = np.concatenate([symbols + 1, [0]])  # a least symbol at the end
    array = np.argsort(text, kind="stable")
    place = np.empty(n, np.int64)
    place[array] = np.arange(n)
    first = np.concatenate([[True], text[array][1:] != text[array][:-1]])
    starts = np.flatnonzero(first)
    group = np.empty(n, np.int64)
    group[array] = np.repeat(starts, np.diff(np.append(starts, n)))
    size = np.zeros(n, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    array, place, group, size = array.tolist(), place.tolist(), group.tolist(), size.tolist()
    group.append(-1)  # of the pointer -1, before the text
    prev = [-1] * n

    end = n
    while end > 0:
        top = group[array[end - 1]]  # start of the group that ends here; all larger ones are final
        members = sorted(array[top:end])
        counts: dict[int, int] = {}
        for i in members:
            j = i - 1
            while group[j] > top:
                j = prev[j]
            if group[j] == top:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        if counts:
            levels: dict[int, list[int]] = {}
            for j, k in counts.items():
                levels.setdefault(k, []).append(j)
            for k in sorted(levels, reverse=True):
                moved: dict[int, int] = {}
                for j in levels[k]:  # to the end of its group, behind which the new group begins
                    g = group[j]
                    taken = moved.get(g, 0) + 1
                    moved[g] = taken
                    at, to = place[j], g + size[g] - taken
                    other = array[to]
                    array[at], place[other] = other, at
                    array[to], place[j] = j, to
                for g, taken in moved.items():
                    if taken == size[g]:
                        continue
                    size[g] -= taken
                    new = g + size[g]
                    size[new] = taken
                    for at in range(new, new + taken):
                        group[array[at]] = new
        end = top

    order = [-1] * n
    following = {}
    placed = [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            to = following.get(g, g)
            following[g] = to + 1
            order[to] = j
            placed[j] = True
            j = prev[j]
    return np.array(order[1:], np.int64)
