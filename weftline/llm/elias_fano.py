"""Elias-Fano sequences and files of arrays that are mapped into memory. Every look-up works on a whole array of questions."""

from __future__ import annotations

import json
import mmap
import uuid
from functools import lru_cache

import numpy as np
import pyarrow.fs

#: Ones (and zeros) between remembered positions.
EVERY = 64
#: Values that a look-up steps over one by one before it halves.
WALK = 4
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _packed_bits(flags: np.ndarray) -> np.ndarray:
    """Flags as 64-bit words, with a word of zeros behind them."""
    out = np.zeros(len(flags) // 64 + 2, np.uint64)
    raw = np.packbits(flags, bitorder="little")
    out.view(np.uint8)[: len(raw)] = raw
    return out


def _pick(words: np.ndarray, start: np.ndarray, nth: np.ndarray, flip: bool) -> np.ndarray:
    """Position of the ``nth`` (from 0) set bit, or clear bit if ``flip``, at or after ``start``."""
    at, nth = start >> 6, nth.copy()
    get = (lambda i: ~words[i]) if flip else (lambda i: words[i])
    now = get(at) & (_ALL << (start & 63).astype(np.uint64))
    n = np.bitwise_count(now).astype(np.int64)
    late = np.flatnonzero(nth >= n)
    while len(late):
        nth[late] -= n[late]
        at[late] += 1
        now[late] = get(at[late])
        n[late] = np.bitwise_count(now[late])
        late = late[nth[late] >= n[late]]
    place = np.zeros(len(at), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(now & np.uint64((1 << width) - 1)).astype(np.int64)
        up = nth >= low
        nth -= low * up
        now = np.where(up, now >> np.uint64(width), now)
        place += width * up
    return at * 64 + place


class EliasFano:
    """A sequence that never falls: low bits packed, high bits in unary, positions of every 64th one and zero remembered."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, top: int) -> None:
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros, self.top = int(n), int(low_bits), low, high, ones, zeros, int(top)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n, largest = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, ((largest + 1) // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part, at = (values & ((1 << bits) - 1)).astype(np.uint64), np.arange(n, dtype=np.int64) * bits
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            spill = np.flatnonzero(shift + np.uint64(bits) > 64)
            np.bitwise_or.at(low, (at[spill] >> 6) + 1, part[spill] >> (np.uint64(64) - shift[spill]))
        top = largest >> bits
        one = (values >> bits) + np.arange(n)
        length = top + n + 1
        taken = np.zeros(length, bool)
        taken[one] = True
        return cls(n, bits, low, _packed_bits(taken), one[::EVERY].astype(np.int64), np.flatnonzero(~taken)[::EVERY].astype(np.int64), top)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.size": np.array([self.n, self.low_bits, self.top], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones, f"{name}.zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits, top = arrays[f"{name}.size"].tolist()
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"], arrays[f"{name}.zeros"], top)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        # shifting by 64 - 0 would be undefined, so the upper word is shifted twice
        both = self.low[word] >> shift | (self.low[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return (both & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        one = _pick(self.high, self.ones[i // EVERY], i % EVERY, False)
        return (one - i) << self.low_bits | self._lows(i)

    def both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at ``i`` and ``i + 1``: the second's one is the next after the first's."""
        one = _pick(self.high, self.ones[i // EVERY], i % EVERY, False)
        at = one + 1
        word = at >> 6
        rest = self.high[word] >> (at & 63).astype(np.uint64) << (at & 63).astype(np.uint64)
        empty = np.flatnonzero(rest == 0)
        while len(empty):
            word[empty] += 1
            rest[empty] = self.high[word[empty]]
            empty = empty[rest[empty] == 0]
        after = (word << 6) + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        return (one - i) << self.low_bits | self._lows(i), (after - i - 1) << self.low_bits | self._lows(i + 1)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each x's successor, the first value at or above it, and whether that is x itself.

        Where x is above all high parts, the index is n. The values that share x's high part are searched by their low parts.
        """
        high = x >> self.low_bits
        inside = (high <= self.top) & (x >= 0) & (self.n > 0)
        h = np.where(inside, high, 0)
        index = np.zeros(len(x), np.int64)
        late = np.flatnonzero(h > 0)
        zero = h[late] - 1
        index[late] = _pick(self.high, self.zeros[zero // EVERY], zero % EVERY, True) - zero
        want = x & ((1 << self.low_bits) - 1)
        hit = np.zeros(len(x), bool)
        walk = np.flatnonzero(inside)
        for _ in range(WALK):
            if not len(walk):
                break
            at = index[walk] + h[walk]
            same = (self.high[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            walk = walk[same]
            low = self._lows(index[walk])
            hit[walk[low == want[walk]]] = True
            walk = walk[low < want[walk]]
            index[walk] += 1
        if len(walk):  # many values share these high parts: halve the rest of them
            zero, begin = h[walk], index[walk]
            end = _pick(self.high, self.zeros[zero // EVERY], zero % EVERY, True) - zero
            stop, aim = end.copy(), want[walk]
            while len(open_ := np.flatnonzero(begin < end)):
                middle = (begin[open_] + end[open_]) >> 1
                less = self._lows(middle) < aim[open_]
                begin[open_] = np.where(less, middle + 1, begin[open_])
                end[open_] = np.where(less, end[open_], middle)
            index[walk] = begin
            there = np.flatnonzero(begin < stop)
            hit[walk[there]] = self._lows(begin[there]) == aim[there]
        return np.where(inside, index, self.n), hit


class Marks:
    """A set of places: bits, and how many are set before each 64 of them."""

    def __init__(self, bits: np.ndarray, before: np.ndarray) -> None:
        self.bits, self.before = bits, before

    @staticmethod
    def arrays(flags: np.ndarray, name: str) -> dict[str, np.ndarray]:
        bits = _packed_bits(flags)
        n = np.bitwise_count(bits).astype(np.int64)
        return {f"{name}.bits": bits, f"{name}.before": np.cumsum(n) - n}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> Marks:
        return cls(arrays[f"{name}.bits"], arrays[f"{name}.before"])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many places before each ``i`` are in the set."""
        word, below = i >> 6, (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.bits[word] & below)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays one after the other, each at a multiple of 64 bytes, behind a line that says where."""
    at, table, parts = 0, {}, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        table[name] = [a.dtype.str, len(a), at]
        parts.append(a.tobytes() + b"\0" * (-a.nbytes % 64))
        at += len(parts[-1])
    head = json.dumps(table).encode()
    return len(head).to_bytes(8, "little") + head + b"\0" * (-(8 + len(head)) % 64) + b"".join(parts)


def unpacked(data: memoryview) -> dict[str, np.ndarray]:
    """The arrays of ``packed`` bytes, as views of them."""
    size = int.from_bytes(data[:8], "little")
    base = 8 + size + -(8 + size) % 64
    return {k: np.frombuffer(data, kind, n, base + at) for k, (kind, n, at) in json.loads(bytes(data[8 : 8 + size])).items()}


class Files:
    """Files of arrays in a shared folder, named by a path or URI. A file is written once, under a name of its own, and never moved
    or changed: a task that runs twice leaves two files, and only the one that its winning attempt names is used."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def place(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), self.folder)

    def write(self, name: str, arrays: dict[str, np.ndarray], exact: bool = False) -> str:
        """The whole name of the new file; ``exact``: ``name`` is that already, and no other attempt takes it."""
        fs, folder = self.place()
        fs.create_dir(folder, recursive=True)
        whole = name if exact else f"{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{folder}/{whole}") as out:
            out.write(packed(arrays))
        return whole

    def map(self, name: str) -> dict[str, np.ndarray]:
        return _opened(self.folder, name)

    def remove(self) -> None:
        """Delete the folder, if it was ever written."""
        fs, folder = self.place()
        if fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(folder)


#: Files that a process holds open at most; the one that was not used for longest is closed.
OPEN = 512


@lru_cache(maxsize=OPEN)
def _opened(folder: str, name: str) -> dict[str, np.ndarray]:
    """A mounted file is mapped, without keeping a descriptor; any other is read."""
    fs, path = Files(folder).place()
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with open(f"{path}/{name}", "rb") as f:
            return unpacked(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)))
    with fs.open_input_file(f"{path}/{name}") as source:
        return unpacked(memoryview(source.read()))
