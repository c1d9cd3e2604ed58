"""Suffix-array dedup of byte strings by bucket-pointer refinement in Spark rounds.

Suffixes stand in buckets of equal first bytes, and a round refines all buckets of the corpus at once:
each suffix asks the part that owns the pair (its bucket, the bucket of a later offset) for the bucket
of twice the depth, and parts sort the pairs and number them.  What is alone in its bucket is not sorted
again.  Bucket numbers, not strings, are compared between documents.

Not every suffix of a corpus can be sorted, so this happens twice.  First the sparse suffixes that begin
at content-defined cuts are refined, the segments between cuts being the initial buckets, and then
pointers to 1 and 2 segments on; a string of segments that a smaller document has too settles all
strings inside it.  Then, of the strings still open, those whose smallest q-gram (by hash) is that of an
open string of another document, and whose largest one too, are refined byte by byte: buckets of equal
half strings, then pairs of the buckets of both halves.  The smallest document with a string is never settled by segments that have
the string, so it is always among those left.

Initial buckets are told apart by 95 and 128 bits of independent hashes of their bytes, all later ones
by bucket numbers.

Cases: a null or empty text has no bytes; a text shorter than ``DEPTH`` keeps all; matches never
cross documents, and repeats inside one document do not count; rows with the same id are one
document, so neither loses to the other; a null id sorts last; equal rows have equal results; an empty
table gives none; columns besides the id and the text are not looked at; a text longer than a batch is
worked on in overlapping pieces, so that only its finished row is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tessera.llm.exchange import Batch, batch_rows, distinct, id_array, joined, lowest, mark_shared, name_shared, names_of, pack
from tessera.llm.hashing import Slices, mix

DEPTH = 50
#: Bytes of the q-grams that cuts and candidates are chosen by; shorter ones are shared by chance more often, longer ones are more.
GRAM = 24
#: A cut's q-gram is the smallest among so many before and after it, so segments between cuts are longer than this.
REACH = 25


def refine(symbols: np.ndarray, at: np.ndarray, depth: int, gram: int = 8) -> np.ndarray:
    """Bucket numbers of the suffixes at ``at`` of one sequence in memory, equal where their first ``depth`` symbols are.

    ``symbols`` are below 256 where ``gram`` is 8, else any non-negative integers with ``gram`` 1.
    Suffixes must have ``depth`` symbols.
    """
    steps, d = [], gram
    while d < depth:
        step = min(d, depth - d)
        steps.append(step)
        d += step
    need, wanted = np.zeros(len(symbols) + 1, dtype=bool), []
    need[at] = True
    for step in reversed(steps):
        wanted.append(np.flatnonzero(need))
        need[wanted[-1] + step] = True
    where = np.flatnonzero(need)
    if gram == 8:
        key = np.zeros(len(where), dtype=np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | symbols[where + k].astype(np.uint64)
    else:
        key = symbols[where]
    pointer = np.zeros(len(symbols) + 1, dtype=np.int64)
    pointer[where] = np.unique(key, return_inverse=True)[1]
    top = int(pointer.max(initial=0)) + 1
    for step, members in zip(steps, reversed(wanted), strict=True):
        old = pointer[members]
        crowded = np.bincount(old, minlength=top)[old] > 1
        new = np.empty(len(members), dtype=np.int64)
        some = members[crowded]
        new[crowded] = np.unique(pointer[some] * top + pointer[some + step], return_inverse=True)[1]
        n = int(new[crowded].max(initial=-1)) + 1
        new[~crowded] = n + np.arange(int((~crowded).sum()))  # alone in its bucket: no need to sort it again
        pointer[members] = new
        top = n + int((~crowded).sum()) + 1
    return pointer[at]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by where they begin."""
    level, have = values, 1
    while 2 * have <= width:
        level = np.minimum(level[:-have], level[have:])
        have *= 2
    return np.minimum(level[: len(values) - width + 1], level[width - have :][: len(values) - width + 1])


class Parsed:
    """A batch's bytes, and what they ask about given the answers so far."""

    def __init__(self, batch: Batch, depth: int):
        self.batch, self.depth, self.half = batch, depth, -(-depth // 2)
        sizes = np.array(batch.sizes, dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.n = int(self.begin[-1])
        self.who = id_array(batch.ids)
        self.long = np.flatnonzero(sizes >= depth)

    @cached_property
    def data(self) -> np.ndarray:
        return np.frombuffer(self.batch.raw, dtype=np.uint8)

    @cached_property
    def slices(self) -> Slices:
        return Slices(self.data)

    @cached_property
    def gram(self) -> np.ndarray:
        """The hash of each q-gram; the largest number where it would cross a document's end."""
        out = np.full(self.n + 1, np.uint64(2**64 - 1))
        x = np.arange(max(0, self.n - GRAM + 1))
        out[: len(x)] = self.slices.hash(x, x + GRAM, 81)
        for k in range(1, GRAM):
            out[np.maximum(self.begin[1:] - k, 0)] = np.uint64(2**64 - 1)
        return out[: self.n]

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, side="right") - 1

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the segments between cuts; a document's begin is a cut."""
        pad = np.full(REACH, np.uint64(2**64 - 1))
        around = sliding_min(np.concatenate([pad, self.gram, pad]), REACH) if self.n else self.gram
        before, after = around[: self.n], around[REACH + 1 :][: self.n]
        cut = (self.gram < before) & (self.gram <= after)
        cut[self.begin[self.long]] = True
        start = np.flatnonzero(cut)
        doc = self.doc(start)
        stop = self.begin[doc + 1]
        end = np.minimum(np.append(start[1:], self.n), stop)
        ok = stop - self.begin[doc] >= self.depth
        return start[ok], end[ok]

    def keys(self, one: np.ndarray, two: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The number of each pair's key, what deals the keys, and distinct pairs with the smallest document of each and whether there are several here."""
        first, at, _ = distinct(one, two)
        low = lowest(at, who, len(first))
        high = -1 - lowest(at, -1 - who, len(first))
        one, two = one[first], two[first]
        return at, mix(one ^ mix(two, 85), 86), [one, two, low, (low != high).astype(np.uint8)]

    def settled(self, state: dict, k: int, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the segments after round ``k``, and an edge count of the strings that a smaller document is known to have."""
        start, end, i, at = (state[c].astype(np.int64) for c in ("start", "end", "asking", "at"))
        who = self.who[self.doc(start[i])]
        name = np.zeros(len(start), np.uint64)
        name[i] = (said >> np.uint64(1))[at]
        dup = ((said & np.uint64(1)) == 1)[at] | (lowest(at, who, len(said))[at] < who)
        until = end[i + (1 << k) - 1] - self.depth + 1  # strings that begin there no longer end in these segments
        ok = dup & (until > start[i])
        edge = state["edge"].copy()
        edge[start[i[ok]]] += 1
        np.add.at(edge, until[ok], -1)
        return name, edge

    def open(self, hit: np.ndarray) -> np.ndarray:
        """Where strings begin that are open yet."""
        mark = np.zeros(self.n + 1, dtype=np.int8)
        mark[self.begin[self.long]] += 1
        mark[self.begin[self.long + 1] - self.depth + 1] -= 1
        inside = np.cumsum(mark[:-1], dtype=np.int8) > 0
        inside[self.batch.own :] = False
        return np.flatnonzero(inside & ~hit)

    def anchors(self, p: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Each string's anchor number, what deals the anchors, and the columns that travel; ``low`` is each string's smallest gram."""
        if not len(p):
            return p, np.zeros(0, np.uint64), [np.zeros(0, np.uint64), np.zeros(0, np.uint8)]
        doc = self.doc(p)
        new = np.append(True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))
        # the smallest hashes crowd at the low end; mixed again they spread over the parts
        keys, first, at = np.unique(mix(low[new], 82) >> np.uint64(16), return_index=True, return_inverse=True)
        who = self.who[doc[new]]
        many = np.zeros(len(keys), dtype=bool)
        np.logical_or.at(many, at, who != who[first][at])
        return at[np.cumsum(new) - 1], keys << np.uint64(16), [keys, many.astype(np.uint8)]

    def both_anchors(self, p: np.ndarray) -> list[tuple]:
        """Anchors by the smallest and by the largest gram of each string."""
        width = self.depth - GRAM + 1
        if not len(p):
            return [self.anchors(p, p)] * 2
        return [self.anchors(p, sliding_min(self.gram, width)[p]), self.anchors(p, sliding_min(~self.gram, width)[p])]

    def halves(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """The initial buckets of the strings at ``p``, equal first and equal last halves: where they begin, key numbers, what deals them, columns."""
        need = np.zeros(self.n + 1, dtype=bool)
        need[p] = True
        need[p + self.depth - self.half] = True
        x = np.flatnonzero(need)
        one, two = self.slices.hash(x, x + self.half, 83), Slices(self.data, 1).hash(x, x + self.half, 84) >> np.uint64(33)
        at, place, (one, two, _, many) = self.keys(one, two, self.who[self.doc(x)])
        return x, at, place, [one, two << np.uint64(1) | many.astype(np.uint64)]


def _refine(part: int, got: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The bucket of each pair that several documents have, and a bit: a smaller document than the batch's has it."""
    (one, two, low, many), cuts = joined(got)
    _, at, count = distinct(one, two)
    shared = count > 1
    np.logical_or.at(shared, at, many > 0)
    name = np.where(shared, names_of(part, np.arange(len(count))), np.uint64(0))
    smaller = lowest(at, low, len(count))[at] < low
    return np.split(name[at] << np.uint64(1) | smaller.astype(np.uint64), cuts)


def _smaller(got: list[list[np.ndarray]]) -> list[np.ndarray]:
    """1 where a smaller document than the batch's has the pair."""
    (one, two, low), cuts = joined(got)
    _, at, count = distinct(one, two)
    return np.split((lowest(at, low, len(count))[at] < low).astype(np.uint8), cuts)


def n_levels(depth: int) -> int:
    """Rounds over segments until a string of segments holds any string of ``depth`` that stands inside a few."""
    most = -(-(depth - 1) // (REACH + 1)) + 1
    return (most - 1).bit_length() + 1


def _marked(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[at] = True
    return out


def _cutter(depth: int):
    def cut(text: bytes, limit: int) -> list[tuple[int, int, int]]:
        return [(a, min(a + limit, len(text)), min(a + limit + depth - 1, len(text))) for a in range(0, len(text), limit)]

    return cut


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, limit: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, data``: bytes covered by a ``depth``-byte string that a smaller document has too are gone.

    The result reads files in the shared folder; they go with ``shared.workspace`` or ``shared.release``.
    ``limit`` is the bytes of a batch, by the input's size if not given.
    """
    if depth < GRAM + 8:
        raise ValueError(f"strings have {GRAM + 8} bytes at least")
    packed = pack(docs, id_col, text_col, limit, apart=True, cut=_cutter(depth))
    levels = n_levels(depth)
    told = None
    for k in range(levels):

        def ask_segments(batch, k=k, told=told):
            x = Parsed(batch, depth)
            if k == 0:
                start, end = x.cuts()
                prints = b"".join(xxhash.xxh3_128_digest(batch.raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True))
                one, two = np.frombuffer(prints, "<u8").reshape(-1, 2).T
                edge, i = np.zeros(x.n + 1, dtype=np.int16), np.arange(len(start))
            else:
                before, step = batch.state(f"level{k - 1}"), 1 << (k - 1)
                name, edge = x.settled(before, k - 1, told(batch, before["place"])[0])
                start, end = before["start"].astype(np.int64), before["end"].astype(np.int64)
                i = np.arange(max(0, len(start) - step))
                doc = x.doc(start)
                i = i[(name[i] > 0) & (name[i + step] > 0) & (doc[i] == doc[i + step])]
                one, two = name[i], name[i + step]
            at, place, columns = x.keys(one, two, x.who[x.doc(start[i])])
            state = {"start": start.astype(np.uint32), "end": end.astype(np.uint32), "asking": i.astype(np.uint32), "at": at.astype(np.uint32), "place": place >> np.uint64(32) << np.uint64(32), "edge": edge}
            return [(place, columns)], state

        kinds = ["<u8", "<u8"] if k == 0 else ["u6", "u6"]
        told = packed.route(ask_segments, lambda part, _, got: _refine(part, got), [[*kinds, "<i8", "u1"]], ["u6"], 0.5, f"level{k}")
        if k:
            packed.forget(f"level{k - 1}")

    def ask_grams(batch, told=told):
        x, before = Parsed(batch, depth), batch.state(f"level{levels - 1}")
        hit = np.cumsum(x.settled(before, levels - 1, told(batch, before["place"])[0])[1][:-1]) > 0
        return [(place, columns) for _, place, columns in x.both_anchors(x.open(hit))], {"hit": np.packbits(hit)}

    grams = packed.route(ask_grams, lambda part, _, got: mark_shared(got, 1), [["u6", "u1"]] * 2, ["u1"] * 2, 0.8, "grams")
    packed.forget(f"level{levels - 1}")

    def ask_halves(batch):
        x = Parsed(batch, depth)
        hit = np.unpackbits(batch.state("grams")["hit"], count=x.n).astype(bool)
        p = x.open(hit)
        (at, place, _), (other_at, other_place, _) = x.both_anchors(p)
        bits, other_bits = grams(batch, place, other_place)
        p = p[(bits & 1 == 1)[at] & (other_bits & 1 == 1)[other_at]] if len(p) else p
        _, _, place, columns = x.halves(p)
        return [(place, columns)], {"hit": np.packbits(hit), "p": np.packbits(_marked(x.n, p))}

    halves = packed.route(ask_halves, lambda part, _, got: name_shared(part, [[one, two >> np.uint32(1), (two & np.uint32(1)).astype(np.uint8)] for one, two in got], 2), [["<u8", "<u4"]], ["u6"], 0.8, "halves")
    packed.forget("grams")

    def ask_strings(batch):
        """The buckets of strings: pairs of the buckets of both halves, where neither is alone."""
        x, before = Parsed(batch, depth), batch.state("halves")
        p = np.flatnonzero(np.unpackbits(before["p"], count=x.n))
        where, at, place, _ = x.halves(p)  # less work than to put them aside
        name = np.zeros(x.n + 1, dtype=np.uint64)
        name[where] = halves(batch, place)[0][at]
        one, two = name[p], name[p + depth - x.half]
        ok = (one > 0) & (two > 0)
        p = p[ok]
        at, place, columns = x.keys(one[ok], two[ok], x.who[x.doc(p)])
        return [(place, columns[:3])], {"hit": before["hit"], "p": np.packbits(_marked(x.n, p)), "at": at.astype(np.uint32), "place": place >> np.uint64(32) << np.uint64(32)}

    strings = packed.route(ask_strings, lambda part, _, got: _smaller(got), [["u6", "u6", "<i8"]], ["u1"], 0.5, "strings")
    packed.forget("halves")

    def gone(batch: Batch) -> tuple[Parsed, np.ndarray]:
        """Which bytes some removed string covers."""
        x, before = Parsed(batch, depth), batch.state("strings")
        hit, p = (np.unpackbits(before[c], count=x.n).astype(bool) for c in ("hit", "p"))
        p, at = np.flatnonzero(p), before["at"].astype(np.int64)
        (bits,) = strings(batch, before["place"])
        who = x.who[x.doc(p)]
        hit[p[(bits[at] == 1) | (lowest(at, who, len(bits))[at] < who)]] = True
        hit[batch.own :] = False
        p = np.flatnonzero(hit)
        edge = np.zeros(x.n + 1, dtype=np.int64)
        edge[p] += 1
        edge[p + depth] -= 1
        return x, np.cumsum(edge[:-1]) > 0

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "data"]

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(it):
            x, mask = gone(batch)
            rows = [_kept(text, mask[x.begin[d] : x.begin[d + 1]]) for d, text in enumerate(batch.texts)]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(batch.ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=names)

    def finish_piece(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(it):
            _, mask = gone(batch)
            columns = [pa.array([batch.row["row"]], pa.int64()), pa.array([batch.piece], pa.int32()), pa.array(batch.ids, pa.int64()), pa.array([batch.raw[: batch.own]], pa.binary()), pa.array([np.packbits(mask).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "piece", "doc_id", "data", "mask"])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        data = table.column("data").to_pylist()
        mask, at = np.zeros(sum(map(len, data)) + depth, dtype=bool), 0
        for own, bits in zip(data, table.column("mask").to_pylist(), strict=True):
            some = np.unpackbits(np.frombuffer(bits, np.uint8), count=min(len(own) + depth - 1, 8 * len(bits))).astype(bool)
            mask[at : at + len(some)] |= some[: len(mask) - at]
            at += len(own)
        *counts, kept = _kept(b"".join(data), mask[:at])
        return pa.table([table.column("doc_id")[:1], *(pa.array([c], pa.int64()) for c in counts), pa.array([kept], pa.binary())], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, data binary"
    ready = packed.answered()
    out = ready.where("piece < 0").mapInArrow(finish, schema)
    if packed.n_pieces:
        pieces = ready.where("piece >= 0").mapInArrow(finish_piece, "row long, piece int, doc_id long, data binary, mask binary")
        out = out.unionByName(pieces.groupBy("row").applyInArrow(whole, schema))
    return out


def _kept(text: bytes, gone: np.ndarray) -> tuple[int, int, int, bytes]:
    """Bytes, removed ones, removed runs, and what is left."""
    n = int(gone.sum())
    if not n:
        return len(text), 0, 0, text
    spans = int((np.diff(np.append(False, gone).astype(np.int8)) == 1).sum())
    return len(text), n, spans, np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
