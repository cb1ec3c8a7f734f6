"""Two-stage suffix sorting of many short strings, to a bounded depth, with numpy."""

from __future__ import annotations

import numpy as np


def _words(data: np.ndarray, at: np.ndarray, word: int) -> np.ndarray:
    """Eight bytes from 8 * word behind each position, as big-endian numbers; data is padded."""
    first = at + 8 * word
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[first + k]
    return out


def _direct_sort(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """at ordered by the depth bytes from each position on: word by word, and only what is still tied."""
    order = at[np.argsort(_words(data, at, 0), kind="stable")]
    tied = np.arange(len(order))
    keys = _words(data, order, 0)
    group = np.zeros(len(order), dtype=np.int64)
    for word in range(1, -(-depth // 8)):
        # group: number of the run of equal keys so far, for the tied ones
        new = np.ones(len(tied), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        size = np.bincount(group)
        stay = size[group] > 1
        tied, group = tied[stay], group[stay]
        if not len(tied):
            break
        keys = _words(data, order[tied], word)
        by = np.lexsort((keys, group))
        order[tied] = order[tied][by]
        keys, group = keys[by], group[by]
    return order


def sorted_starts(data: np.ndarray, first: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
    """The starts of all substrings of depth bytes of the strings data[first : first + length], in lexicographic order.

    Suffixes that are smaller than their successor are sorted directly. The others are induced:
    scanning the buckets of first bytes in ascending order, each suffix in place puts its predecessor,
    if that is larger, behind what its bucket holds so far. Only starts of full substrings are sorted,
    and behind the last of a string the positions up to the next one sorted directly.
    """
    data = np.concatenate([data, np.zeros(depth + 16, dtype=np.uint8)])
    n = int(length.sum())
    if not n:
        return np.zeros(0, dtype=np.int64)
    end = np.zeros(len(data), dtype=bool)  # the last byte of a string: its suffix is sorted directly
    end[first + length - 1] = True
    # -1: smaller than its successor, 1: larger; equal bytes take the type of what follows
    step = np.sign(data[:-1].astype(np.int16) - data[1:]).astype(np.int8)
    step[end[:-1]] = -1
    known = np.flatnonzero(step)
    kind = step[known[np.minimum(np.searchsorted(known, np.arange(len(step))), len(known) - 1)]]
    full = np.zeros(len(step), dtype=bool)
    begin = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(begin, first, 1)
    np.add.at(begin, first + length - depth + 1, -1)
    full = np.cumsum(begin)[: len(step)] > 0
    # a position counts if it is a start, or the one before it counts and is induced from it
    smaller = np.flatnonzero(kind < 0)
    anchor = smaller[np.minimum(np.searchsorted(smaller, np.arange(len(step))), len(smaller) - 1)]
    last = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(last, first, 1)
    np.add.at(last, anchor[first + length - depth] + 1, -1)
    used = np.cumsum(last)[: len(step)] > 0

    direct = _direct_sort(data, np.flatnonzero(used & (kind < 0)), depth)
    edges = np.searchsorted(data[direct], np.arange(257))
    induced = used & (kind > 0)
    induced = np.concatenate([induced, [False]])  # induced[-1] serves the predecessor of position 0
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        parts = waiting[byte]
        front = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        whole = [front]
        while len(front):  # runs of the same byte
            before = front - 1
            front = before[induced[before] & (data[before] == byte)]
            whole.append(front)
        whole.append(direct[edges[byte] : edges[byte + 1]])
        bucket = np.concatenate(whole)
        waiting[byte] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket - 1
        before = before[induced[before] & (data[before] > byte)]
        chars = data[before]
        by = np.argsort(chars, kind="stable")
        before, chars = before[by], chars[by]
        cut = np.flatnonzero(np.diff(chars)) + 1
        for part in np.split(before, cut) if len(before) else []:
            waiting[int(data[part[0]])].append(part)
    order = np.concatenate(out)
    return order[full[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each start but the first, the bytes it has in common with the one before it, depth at most."""
    data = np.concatenate([data, np.zeros(depth, dtype=np.uint8)])
    out = np.zeros(max(len(order) - 1, 0), dtype=np.int32)
    alive = np.arange(len(out))
    for k in range(depth):
        alive = alive[data[order[alive] + k] == data[order[alive + 1] + k]]
        if not len(alive):
            break
        out[alive] += 1
    return out
