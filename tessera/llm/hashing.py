"""Vectorised hashes of bytes, words and windows, and a minimal perfect hash, in numpy.

A string's hash is a polynomial over random 64-bit byte values with an odd multiplier modulo 2**64.
One prefix sum over a buffer then gives the hash of any slice, wherever the slice stands.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Two independent families of polynomials.
_MULTS = (0xD1342543DE82EF97, 0x2545F4914F6CDD1D)
_BYTES = [np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64) | U64(1) for seed in (20240229, 20240301)]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; another seed is another function."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _power(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        if n <= 1 << 22:  # arrays for a single huge text are not kept
            _powers[base] = have
    return have[:n]


class Slices:
    """Hashes of slices of a sequence of 64-bit values (or of bytes); another ``family`` gives independent ones."""

    def __init__(self, values: np.ndarray, family: int = 0):
        if values.dtype == np.uint8:
            values = _BYTES[family][values]
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * _power(n, _MULTS[family]), out=self.sums[1:])
        self.back = _power(n + 1, pow(_MULTS[family], -1, 1 << 64))

    def hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[end] - self.sums[start]) * self.back[start]
            return mix(raw + (end - start).astype(np.uint64) * U64(0xA24BAED4963EE407), seed)


WORD = np.ones(256, dtype=bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False


def word_spans(data: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``table`` marks."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = table[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Joined:
    """Texts laid end to end with one space between, with their words."""

    def __init__(self, texts: list[bytes], table: np.ndarray = WORD, lower: bool = False):
        raw = b" ".join(texts)
        self.data = np.frombuffer(raw.lower() if lower else raw, dtype=np.uint8)
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])[: len(texts)].astype(np.int64)
        self.end = self.begin + sizes
        self.word_start, self.word_end = word_spans(self.data, table)
        #: words of document i are first[i]:first[i + 1]
        self.first = np.append(np.searchsorted(self.word_start, self.begin), len(self.word_start)).astype(np.int64)
        self.n_words = np.diff(self.first)

    def word_hashes(self) -> np.ndarray:
        return Slices(self.data).hash(self.word_start, self.word_end)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bit arrays, each key at its first lone bit.

    ``slot`` maps each built key to its own number below ``n``; any other key gets some slot or -1,
    so callers keep fingerprints beside the slots.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        self.n = len(keys)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.sizes: list[int] = []
        left, base = np.asarray(keys, dtype=np.uint64), 0
        while len(left) and len(self.levels) < 32:
            size = max(8, int(gamma * len(left)))
            at = (mix(left, 101 + len(self.levels)) % U64(size)).astype(np.int64)
            lone = np.bincount(at, minlength=size) == 1
            self.levels.append((np.packbits(lone), base + self._ranks(lone)))
            self.sizes.append(size)
            base += int(lone.sum())
            left = left[~lone[at]]
        self.rest, self.base = np.sort(left), base

    @staticmethod
    def _ranks(bits: np.ndarray) -> np.ndarray:
        """Set bits before each block of 8."""
        pad = np.zeros(-(-len(bits) // 8) * 8, dtype=np.uint8)
        pad[: len(bits)] = bits
        counts = pad.reshape(-1, 8).sum(axis=1)
        return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)

    _COUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, ((bits, ranks), size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            if not len(todo):
                return out
            at = (mix(keys[todo], 101 + level) % U64(size)).astype(np.int64)
            byte, bit = bits[at >> 3].astype(np.int64), at & 7
            hit = (byte >> (7 - bit)) & 1 == 1
            before = self._COUNT[byte >> (8 - bit)]
            out[todo[hit]] = (ranks[at >> 3] + before)[hit]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.searchsorted(self.rest, keys[todo]).clip(0, len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.base + at[hit]
        return out

    def to_bytes(self) -> bytes:
        import io

        out = io.BytesIO()
        np.savez(out, n=self.n, base=self.base, rest=self.rest, sizes=np.array(self.sizes, dtype=np.int64), **{f"b{i}": b for i, (b, _) in enumerate(self.levels)}, **{f"r{i}": r for i, (_, r) in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        import io

        z = np.load(io.BytesIO(raw))
        self = cls.__new__(cls)
        self.n, self.base, self.rest, self.sizes = int(z["n"]), int(z["base"]), z["rest"], z["sizes"].tolist()
        self.levels = [(z[f"b{i}"], z[f"r{i}"]) for i in range(len(self.sizes))]
        return self
