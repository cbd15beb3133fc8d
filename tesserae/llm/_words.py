"""Words and their hashes from whole batches of texts, without a Python step for each word.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  A word's
hash is a polynomial over its bytes modulo 2**64, mixed.  It is the same on every
machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at a time; a longer text takes its own size.
GROUP_BYTES = 250_000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_powers: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, GROUP_BYTES + 65_536)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(size, base, dtype=_U)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end of each word in data; bounds of each text among the words).

    data: bytes of all texts end to end; bounds: where each begins, and the end.
    """
    n, texts = len(data), len(bounds) - 1
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string array; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def groups(bounds: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about that many bytes."""
    start, n = 0, len(bounds) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1)
        yield start, min(end, n)
        start = end


def regrouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about that many bytes, for work that has a cost for each batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def each_group(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, after the last, bytes, word hashes, starts, ends, bounds among the words) for groups of texts."""
    data, bounds = text_buffers(texts)
    for a, b in groups(bounds):
        part = data[bounds[a] : bounds[b]]
        yield a, b, part, *hashed_words(part, bounds[a : b + 1] - bounds[a])


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of size words inside a text, bounds of each text among them).

    A text with fewer words has one shingle, the whole of it; one without words has none.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(len(counts)), made)
    first = bounds[:-1][owner] + np.arange(out_bounds[-1]) - out_bounds[:-1][owner]
    total = np.zeros(out_bounds[-1], dtype=_U)
    last = bounds[1:][owner]
    for k in range(size):
        at = first + k
        ok = at < last
        value = words[np.minimum(at, len(words) - 1)] * _U((0xD6E8FEB86659FD93 * (2 * k + 1)) & (2**64 - 1)) if len(words) else total
        total = total * _U(0x2545F4914F6CDD1D) + np.where(ok, value, _U(0))
    return mix(total), out_bounds
