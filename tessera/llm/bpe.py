"""Byte-level BPE by ranks with a hierarchical-bitmap queue over merge ranks.

A pre-token's bytes form a linked list.  Each adjacent pair with a rank stands in that rank's bucket
of list positions; a two-level bitmap over the ranks finds the lowest rank in use by find-first-set,
and entries that a merge has outdated are skipped when their bucket comes up.  A pre-token of n bytes
takes O(n) queue steps of a heap's logarithm each at most, so megabytes without a break do no harm.  Encoded pre-tokens are kept in
bounded caches.

Cases: null and empty texts have no ids; ids of a text concatenate those of its pre-tokens; rows with the
same id or none are encoded each, and equal rows alike; an empty table gives none; columns besides the id
and the text are not looked at; a very long text is encoded whole, with some 60 bytes for each byte of its
longest pre-token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.shared import narrow, trim

#: Entries in each generation of a worker's cache; two generations are kept, so frequent pieces outlive rare ones.
CACHE = 400_000
#: Known pairs of tokens that a worker keeps.
PAIRS = 200_000
#: A lone space between two characters that are not white space, led by the space so that the search can skip to it.
_CHUNKS = re.compile(r" (?<=\S )(?=\S)")


def load_ranks(lines: bytes) -> dict[bytes, int]:
    out = {}
    for line in lines.splitlines():
        if line:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


#: Alternatives of patterns in which a lone space between two characters that are not white space always begins a pre-token.
_BEGINS = re.compile(r"'(?:[a-z]+|\(\?:[a-z|]+\))| \?\\p\{[LN]\}\+| \?\[\^\\s\\p\{L\}\\p\{N\}\]\+|\\s\+\(\?!\\S\)|\\s\+")


def begins_at_space(pattern: str) -> bool:
    """Whether texts may be cut before such spaces: each alternative is one of those known to allow it."""
    return all(_BEGINS.fullmatch(x) for x in pattern.split("|"))


class Encoder:
    """Encodes by ranks and a pattern of pre-tokens; texts are cut into chunks first where the pattern is known to allow it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks, self.pattern, self.limit, self.chunks = ranks, regex.compile(pattern), cache, begins_at_space(pattern)
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.token = {v: k for k, v in ranks.items()}
        self.pairs: dict[int, int] = {}
        self.of_bytes = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.buckets: list[list[int] | None] = [None] * (max(ranks.values()) + 1)
        self.middle = [0] * (len(self.buckets) // 256 + 1)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def pair(self, key: int) -> int:
        """The rank of tokens ``key >> 32`` and ``key & 0xFFFFFFFF`` joined, or -1."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        rank = self.pairs[key] = self.ranks.get(self.token[key >> 32] + self.token[key & 0xFFFFFFFF], -1)
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        ``top`` and ``middle`` are the two levels of the bitmap over ranks, 256 ranks to a word:
        ``x & -x`` is the lowest set bit.  A bucket is a heap of positions, for equal ranks merge from
        the left; it is asked for anew after each merge, which may have made a pair of a lower rank.
        The queue is written out here, for a call per step would cost more than the step; it is empty
        between calls.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        known, pair, buckets, middle, of_bytes = self.pairs, self.pair, self.buckets, self.middle, self.of_bytes
        ids = list(map(self.byte.__getitem__, piece))
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [of_bytes[a << 8 | b] for a, b in zip(piece, piece[1:])]  # noqa: B905
        rank_at.append(-1)
        top = 0
        for i, r in enumerate(rank_at):
            if r >= 0:
                bucket = buckets[r]
                if bucket:
                    bucket.append(i)  # ascending, so still a heap
                else:
                    buckets[r] = [i]
                    middle[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
        while top:
            high = (top & -top).bit_length() - 1
            word = middle[high]
            low = word & -word
            rank = high << 8 | (low.bit_length() - 1)
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                buckets[rank] = None
                middle[high] = word = word ^ low
                if not word:
                    top ^= 1 << high
            if rank_at[i] != rank:
                continue  # outdated
            j = after[i]
            k = after[i] = after[j]
            ids[i] = rank
            rank_at[j] = r = -1
            if k < n:
                before[k] = i
                key = rank << 32 | ids[k]
                r = known.get(key)
                if r is None:
                    r = pair(key)
                if r >= 0:
                    bucket = buckets[r]
                    if bucket:
                        heappush(bucket, i)
                    else:
                        buckets[r] = [i]
                        middle[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
            rank_at[i] = r
            h = before[i]
            if h >= 0:
                key = ids[h] << 32 | rank
                r = known.get(key)
                if r is None:
                    r = pair(key)
                if r >= 0:
                    bucket = buckets[r]
                    if bucket:
                        heappush(bucket, h)
                    else:
                        buckets[r] = [h]
                        middle[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
                rank_at[h] = r
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def spaced(self, text: str) -> bytes:
        """The ids of a space and ``text``, which is a chunk or a pre-token; both share one cache, for a pre-token alone is cut like itself."""
        got = self.old.get(text)
        if got is None:
            pieces = self.pattern.findall(" " + text)
            got = array("I", self.merge(pieces[0].encode())).tobytes() if len(pieces) == 1 else b"".join(map(self.piece, pieces))
        if len(text) <= 64:
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[text] = got
        return got

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token."""
        if len(text) > 1 and text[0] == " " and not text[1].isspace():
            return self.new.get(text[1:]) or self.spaced(text[1:])
        got = self.bare.get(text)
        if got is None:
            got = array("I", self.merge(text.encode())).tobytes()
            if len(text) <= 64:
                if len(self.bare) >= self.limit // 4:
                    self.bare.clear()
                self.bare[text] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers.

        A pattern that ``begins_at_space`` never joins what stands before and after a lone space between
        two characters that are not white space, so such a space is where chunks begin.
        """
        if not text:
            return b""
        if not self.chunks:
            return b"".join([array("I", self.merge(x.encode())).tobytes() for x in self.pattern.findall(text)])
        first, *rest = _CHUNKS.split(text)
        get, spaced = self.new.get, self.spaced
        out = list(map(self.piece, self.pattern.findall(first)))
        out += [get(part) or spaced(part) for part in rest]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, array("I", ids)))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder for a rank file, loaded once in each worker."""
    if (path, pattern) not in _encoders:
        with open(path, "rb") as f:
            _encoders[path, pattern] = Encoder(load_ranks(f.read()), pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` with ids as binary little-endian 32-bit integers; one scan, no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in slices(it):
            ids = [enc.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def slices(it: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to ``rows``, so that what Python makes of them stays small."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    trim()


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, data``: the bytes that the ids stand for beside them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in it:
            data = [enc.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, data binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, decode the ids, and digest both in one Python worker per task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in slices(it):
            n, own, back = [], [], []
            for text in b.column("text").to_pylist():
                ids = enc.encode(text)
                n.append(len(ids) // 4)
                own.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
