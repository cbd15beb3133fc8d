"""Elias-Fano sequences over numpy arrays, queried many values at a time, and files of arrays to map into memory."""

from __future__ import annotations

import functools
import json
import uuid
from collections import OrderedDict

import numpy as np

from ._common import file_system, replace_file

_U = np.uint64
_BLOCK = 8  # words of 64 bits between entries of the directory of zeros


def _pack_low(values: np.ndarray, bits: int) -> np.ndarray:
    if not bits or not len(values):
        return np.zeros(2, _U)
    mask = _U((1 << bits) - 1)
    parts = []
    for a in range(0, len(values), 1 << 17):  # a multiple of 8 values fills whole bytes
        some = np.unpackbits((values[a : a + (1 << 17)] & mask).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        parts.append(np.packbits(some[:, :bits].ravel(), bitorder="little"))
    data = np.concatenate(parts)
    out = np.zeros((len(data) + 7) // 8 * 8 + 8, np.uint8)
    out[: len(data)] = data
    return out.view(_U)


class EliasFano:
    """A sorted sequence: low bits packed, high bits in unary, zeros counted for each block of words."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros
        self._ones_before: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """values: sorted uint64 below the universe."""
        n = len(values)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = min(bits, 63)
        size = n + ((universe - 1) >> bits if universe else 0) + 2
        flags = np.zeros((size + 64 * _BLOCK - 1) // (64 * _BLOCK) * (64 * _BLOCK), np.uint8)
        if n:
            flags[(values >> _U(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(_U)
        ones = np.bitwise_count(high).astype(np.int64).reshape(-1, _BLOCK).sum(axis=1)
        zeros = np.concatenate([[0], np.cumsum(64 * _BLOCK - ones)])[:-1]
        return cls(n, bits, _pack_low(values, bits), high, zeros)

    def select0(self, k: np.ndarray) -> np.ndarray:
        """The place of the zero number k, from 0."""
        block = np.searchsorted(self.zeros, k, side="right") - 1
        rest = k - self.zeros[block]
        word = block * _BLOCK
        for _ in range(_BLOCK - 1):
            there = 64 - np.bitwise_count(self.high[word]).astype(np.int64)
            on = rest >= there
            if not on.any():
                break
            rest -= np.where(on, there, 0)
            word += on
        bits, place = ~self.high[word], word * 64
        for width in (32, 16, 8, 4, 2, 1):
            there = np.bitwise_count(bits & _U((1 << width) - 1)).astype(np.int64)
            on = rest >= there
            rest -= np.where(on, there, 0)
            bits = np.where(on, bits >> _U(width), bits)
            place += np.where(on, width, 0)
        return place

    def _next_zero(self, before: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the zero number k, after that of the zero before it: mostly in the same word."""
        at = before + 1
        bits = ~self.high[at >> 6] >> (at & 63).astype(_U)
        place = at + np.bitwise_count((bits & (~bits + _U(1))) - _U(1))
        far = np.flatnonzero(bits == 0)
        if len(far):
            place[far] = self.select0(k[far])
        return place

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(_U)
        value = self.low[word] >> off
        value |= np.where(off > 0, self.low[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return value & _U((1 << self.bits) - 1)

    def select1(self, k: np.ndarray) -> np.ndarray:
        """The place of the one number k, from 0: that of value number k."""
        block = np.searchsorted(self._ones(), k, side="right") - 1
        rest = k - self._ones()[block]
        word = block * _BLOCK
        for _ in range(_BLOCK - 1):
            there = np.bitwise_count(self.high[word]).astype(np.int64)
            on = rest >= there
            if not on.any():
                break
            rest -= np.where(on, there, 0)
            word += on
        bits, place = self.high[word].copy(), word * 64
        for width in (32, 16, 8, 4, 2, 1):
            there = np.bitwise_count(bits & _U((1 << width) - 1)).astype(np.int64)
            on = rest >= there
            rest -= np.where(on, there, 0)
            bits = np.where(on, bits >> _U(width), bits)
            place += np.where(on, width, 0)
        return place

    def _ones(self) -> np.ndarray:
        if self._ones_before is None:
            self._ones_before = np.arange(len(self.zeros)) * (64 * _BLOCK) - self.zeros
        return self._ones_before

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values number i."""
        if not len(i):
            return np.zeros(0, _U)
        return ((self.select1(i) - i).astype(_U) << _U(self.bits)) | self.low_bits(i)

    def access_pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values number i and those after them: the next one is mostly in the same word."""
        at = self.select1(i)
        bits = self.high[(at + 1) >> 6] >> ((at + 1) & 63).astype(_U)
        place = at + 1 + np.bitwise_count((bits & (~bits + _U(1))) - _U(1))
        far = np.flatnonzero(bits == 0)
        if len(far):
            place[far] = self.select1(i[far] + 1)
        value = lambda p, k: ((p - k).astype(_U) << _U(self.bits)) | self.low_bits(k)
        return value(at, i), value(place, i + 1)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many values lie below x, whether x itself is there) for each x below the universe."""
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        return self._sought(x, np.zeros(len(x), np.int64), np.full(len(x), self.n))

    def successor_in(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the place of the first value not under x, whether it is x) among the values from first to before last, for each x of any size."""
        if not self.n or not len(x):
            return first.copy(), np.zeros(len(x), bool)
        inside = (x >> _U(self.bits)) < _U(64 * len(self.high) - self.n - 1)  # beyond lies no value
        if inside.all():
            return self._sought(x, first, last)
        at, there = last.copy(), np.zeros(len(x), bool)
        at[inside], there[inside] = self._sought(x[inside], first[inside], last[inside])
        return at, there

    def _sought(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = (x >> _U(self.bits)).astype(np.int64)
        low = x & _U((1 << self.bits) - 1)
        before = np.where(high > 0, self.select0(np.maximum(high - 1, 0)), -1)
        # the values with these high bits, two on average, as far as they lie in the range
        end = np.clip(self._next_zero(before, high) - high, first, last)
        begin = np.clip(before - (high - 1), first, last)
        top = end.copy()
        while (open_ := begin < end).any():
            middle = (begin + end) >> 1
            less = open_ & (self.low_bits(np.minimum(middle, self.n - 1)) < low)
            begin, end = np.where(less, middle + 1, begin), np.where(open_ & ~less, middle, end)
        return begin, (begin < top) & (self.low_bits(np.minimum(begin, self.n - 1)) == low)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")[: None])[: self.n]
        return ((ones - np.arange(self.n)).astype(_U) << _U(self.bits)) | self.low_bits(np.arange(self.n))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.shape": np.array([self.n, self.bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = (int(x) for x in arrays[f"{name}.shape"])
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"])


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays; a task that runs again replaces it with the same bytes."""
    system, place = file_system(path)
    parts, head, at = [], {}, 0
    for name, x in arrays.items():
        data = np.ascontiguousarray(x).tobytes()
        head[name] = (x.dtype.str, len(x), at)
        parts.append(data + b"\0" * (-len(data) % 8))
        at += len(parts[-1])
    said = json.dumps(head).encode()
    said += b" " * (-len(said) % 8)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    aside = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(len(said).to_bytes(8, "little") + said)
        for data in parts:
            out.write(data)
    replace_file(system, aside, place)


#: Bytes of files of a remote store that a process holds at a time.
HELD_BYTES = 256_000_000
_held: OrderedDict[str, np.ndarray] = OrderedDict()


@functools.lru_cache(maxsize=4096)
def _mapped(place: str) -> np.ndarray:
    return np.memmap(place, np.uint8, "r").view(np.ndarray)


def _remote(system, path: str, place: str) -> np.ndarray:
    """A file of a remote store, in memory: the last used ones up to HELD_BYTES stay, and no machine's own folder comes in."""
    if path not in _held:
        with system.open_input_file(place) as data:
            _held[path] = np.frombuffer(data.read_buffer(), np.uint8)
        while len(_held) > 1 and sum(map(len, _held.values())) > HELD_BYTES:
            _held.popitem(last=False)
    _held.move_to_end(path)
    return _held[path]


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped into memory from a shared folder, read from a remote store."""
    from pyarrow import fs

    system, place = file_system(path)
    whole = _mapped(place) if isinstance(system, fs.LocalFileSystem) else _remote(system, path, place)
    size = int(whole[:8].view("<u8")[0])
    head, body = json.loads(bytes(whole[8 : 8 + size])), whole[8 + size :]
    return {name: body[at : at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in head.items()}
