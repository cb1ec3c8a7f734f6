"""Words and word shingles of many texts at once, as numpy arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task turns into arrays at a time; a longer text stands alone.
CHUNK_BYTES = 1 << 18
#: Rows of a batch that are Python objects at a time.
SLICE_ROWS = 256

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Powers of more than 2 to this are products of two short tables.
_TABLE_BITS = 16


def _classes() -> np.ndarray:
    """Byte to lower-cased byte plus one, 0 for bytes outside words."""
    table = np.zeros(256, dtype=np.uint64)
    word = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    table[word] = np.array(word, dtype=np.uint64) + 1
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


CLASS = _classes()
IN_WORD = CLASS > 0
_IN_WORD_BYTES = IN_WORD.tobytes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base up to the nth: those by the last _TABLE_BITS of the exponent, and by the rest of it."""
    return powers(base, min(n, 1 << _TABLE_BITS)), powers(np.uint64(pow(int(base), 1 << _TABLE_BITS, 1 << 64)), (n >> _TABLE_BITS) + 1)


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) of consecutive texts with about CHUNK_BYTES together; null counts as empty."""
    first, held, size = 0, [], 0
    rows = (text for at in range(0, len(texts), SLICE_ROWS) for text in texts.slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist())
    for i, text in enumerate(rows):
        text = text or b""
        if held and size + len(text) > CHUNK_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte (in their own text) of every word, and the bounds of each text's words."""
    joined = b"\n".join([*texts, b""])
    data, inside = np.frombuffer(joined, dtype=np.uint8), np.frombuffer(joined.translate(_IN_WORD_BYTES), dtype=bool)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.searchsorted(starts, np.concatenate([begin, [len(data)]]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, bounds
    # a word's bytes times powers of _BASE: a difference of sums over all bytes, over the power of the word's start
    low, high = _power_tables(_BASE, len(data))
    sums = CLASS[data]
    for k, factor in enumerate(high):
        sums[k << _TABLE_BITS : (k + 1) << _TABLE_BITS] *= low[: len(sums) - (k << _TABLE_BITS)] * factor
    np.cumsum(sums, out=sums)
    hashes = np.diff(sums[ends - 1], prepend=np.uint64(0))
    low, high = _power_tables(_INVERSE, len(data))
    hashes = mixed(hashes * low[starts & (1 << _TABLE_BITS) - 1] * high[starts >> _TABLE_BITS])
    own = np.repeat(begin, np.diff(bounds))
    return hashes, starts - own, ends - own, bounds


def shingles_of(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words of each text, and their bounds; a text of fewer words, but not none, is one run."""
    counts = np.diff(bounds)
    each = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(each)])
    factors = powers(_STEP, size)
    run = np.zeros(max(len(hashes) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        run += hashes[k : len(hashes) - size + 1 + k] * factors[k]
    run = mixed(run)
    long = np.flatnonzero(counts >= size)
    at = np.repeat(bounds[long] - out_bounds[long], each[long]) + _ranges(out_bounds[long], each[long])
    out = np.zeros(int(out_bounds[-1]), dtype=np.uint64)
    out[_ranges(out_bounds[long], each[long])] = run[at]
    for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        words = hashes[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = mixed(np.array([(words * factors[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))]))[0]
    return out, out_bounds


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all the ranges, one after another."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(int(lengths.sum())) - np.repeat(first - starts, lengths)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, _, _, bounds = words_of(texts)
    shingles, at = shingles_of(hashes, bounds, size)
    return [np.unique(shingles[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class MinHash:
    """Signatures of sets of 64-bit hashes: the least value of each under random linear maps of 32 bits."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, size, dtype=np.uint32)

    def signatures(self, sets: Iterable[np.ndarray]) -> np.ndarray:
        """One row for each set; the sets must not be empty."""
        sets = list(sets)
        if not sets:
            return np.zeros((0, len(self.factor)), dtype=np.uint32)
        values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        out = np.empty((len(self.factor), len(sets)), dtype=np.uint32)
        for k, (factor, shift) in enumerate(zip(self.factor, self.shift, strict=True)):
            out[k] = np.minimum.reduceat(values * factor + shift, starts)
        return np.ascontiguousarray(out.T)
