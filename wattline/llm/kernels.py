"""numpy kernels over Arrow string buffers: word hashes and n-gram hashes.

A batch's texts are one byte buffer with offsets.  The kernels walk it in blocks
of about a megabyte, so scratch memory does not grow with the batch or with one
long text; what is kept is eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from wattline.llm.text import SPACE_BYTES

BLOCK = 1 << 20
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches small enough for eight bytes a word in memory."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + (BLOCK >> 2))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def byte_sums(block: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, shifted by a power, hash any span of bytes."""
    sums = np.zeros(len(block) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[block] * up[: len(block)], out=sums[1:])
    return sums


def lowered(block: np.ndarray) -> np.ndarray:
    return _LOWER[block]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if big else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks that end at a text's end or, inside a long text, at white space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        limit = at + BLOCK
        if limit >= end:
            yield at, end
            return
        cut = int(offsets[np.searchsorted(offsets, limit, "right") - 1])
        if cut <= at:
            stop = int(offsets[np.searchsorted(offsets, limit, "left")])
            cut = stop
            for p in range(limit, stop, BLOCK):
                space = np.flatnonzero(_IS_SPACE[data[p : min(p + BLOCK, stop)]])
                if len(space):
                    cut = p + int(space[0])
                    break
        yield at, cut
        at = cut


def word_spans(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, hashes) of the words, block by block; places are in ``data``."""
    for a, b in _cuts(data, offsets):
        block = _LOWER[data[a:b]] if lower else data[a:b]
        up, down = power_tables(b - a)
        space = _IS_SPACE[block]
        edge = np.zeros(b - a + 1, dtype=bool)
        i, j = np.searchsorted(offsets, (a, b), "left")
        edge[offsets[i : j + 1][offsets[i : j + 1] <= b] - a] = True
        edge[0] = edge[-1] = True
        before = edge[:-1].copy()
        before[1:] |= space[:-1]
        after = edge[1:].copy()
        after[:-1] |= space[1:]
        inside = ~space
        starts = np.flatnonzero(inside & before)
        ends = np.flatnonzero(inside & after) + 1
        sums = byte_sums(block, up)
        yield starts + a, ends + a, mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text)."""
    found, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    for starts, _, hashes in word_spans(data, offsets, lower):
        found.append(hashes)
        counts += np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(counts))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def gram_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every ``size``-word shingle, number of shingles of every text).

    A text with 1 to ``size`` - 1 words has one shingle, its whole sequence.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    times = np.uint64(0xD6E8FEB86659FD93)
    if len(words) >= size:
        rolled = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            rolled = rolled * times + words[k : len(words) - size + 1 + k]
    else:
        rolled = np.zeros(0, np.uint64)
    out = np.zeros(int(n.sum()), dtype=np.uint64)
    to = np.cumsum(n) - n
    full = counts >= size
    if full.any():
        reach = n[full]
        where = np.repeat(starts[full] - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
        place = np.repeat(to[full] - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
        out[place] = rolled[where]
    for i in np.flatnonzero((counts > 0) & ~full):
        h = int(counts[i])
        for w in words[starts[i] : ends[i]].tolist():
            h = (h * int(times) + w) % (1 << 64)
        out[to[i]] = h
    return mix(out), n


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def lists_of(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(np.ascontiguousarray(values))))
