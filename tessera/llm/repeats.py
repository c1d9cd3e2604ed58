"""Substring dedup of word windows by recompression in Spark rounds.

A first round names the corpus's words: each batch asks with its distinct words, and the parts that own
them number those that stand twice or more.  Each further round names, over the whole corpus, runs of
one symbol and pairs of neighbouring symbols: a run is one symbol with its length, a bit of a symbol's
hash makes it a left or a right half, and a left half joins the right half behind it.  Whether two
symbols join depends on nothing but the two, so equal substrings get equal interior symbols in whatever
document they stand, and names agree because one part gives them.  What stands once in the corpus gets no
name and joins nothing further.

Strings of high-level symbols that stand twice show long repeats at once: every window inside one is a
repeat.  What such a string does not settle, mostly windows across a repeat's ends, is verified window by
window on the words' names; of these windows only those are asked about whose anchor, the smallest of
their word q-grams, stands elsewhere too; and where a string has shown a repeat, one occurrence stands for
all of them.

Words are told apart by 96 bits of a hash, runs and pairs by their names, strings and windows by 96 bits
of two hashes of their names.

Cases: a null or wordless text keeps nothing and removes nothing; a text shorter than a window keeps
all; repeats within one document count; overlapping windows of a periodic text are repeats of each
other; rows with the same id count one by one, and null ids like others; equal rows have equal results;
an empty table gives none; columns besides the id and the text are not looked at; a text longer than a
batch is worked on in overlapping pieces, so that only its finished row is ever held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tessera.llm.exchange import Batch, batch_rows, distinct, mark_shared, name_shared, pack
from tessera.llm.hashing import Joined, Slices, mix
from tessera.llm.suffixes import sliding_min

WINDOW = 35
#: Words of the q-grams that anchors are chosen by.
GRAM = 8
#: Rounds of runs and pairs: symbols have about (4/3)**5 = 4 words then, but for runs, which have any number.
ROUNDS = 5
_WORD, _SPACE = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[\x20\x09-\x0D]")

#: Keys of a batch: the number of each asker's key, what deals the keys, and the columns that travel.
Keys = tuple[np.ndarray, np.ndarray, list[np.ndarray]]


def _keys(*columns: np.ndarray) -> Keys:
    """Distinct keys of several columns, and whether each stands here twice."""
    first, at, count = distinct(*columns)
    some = [c[first] for c in columns]
    place = np.zeros(len(first), dtype=np.uint64)
    for k, c in enumerate(some):
        place = mix(place ^ c.astype(np.uint64), 60 + k)
    return at, place, [*some, (count > 1).astype(np.uint8)]


class Symbols:
    """A parse of a batch's words: names (0: none) and first words; documents never share a symbol."""

    def __init__(self, name: np.ndarray, start: np.ndarray, first: np.ndarray):
        """``first`` are the documents' first words, and the number of words."""
        self.name, self.start, self.first = name, start, first

    def wanted(self, round_: int) -> tuple[Keys, tuple]:
        """What a round asks for, pairs of runs and runs that pair with nothing as (name, length, name, length), and what ``named`` needs."""
        n, words = len(self.name), int(self.first[-1])
        new_doc = np.zeros(words + 1, dtype=bool)
        new_doc[self.first] = True
        begins = new_doc[self.start]  # a document's first word is a symbol's first
        same = np.zeros(n, dtype=bool)
        same[1:] = (self.name[1:] == self.name[:-1]) & ~begins[1:] & (self.name[1:] > 0)
        head = np.flatnonzero(~same)
        size = np.diff(np.append(head, n)).astype(np.uint64)
        name, begins = self.name[head], begins[head]
        with np.errstate(over="ignore"):
            left = mix(name * np.uint64(31) + size, 100 + round_) & np.uint64(1) == 1
        joins = np.zeros(len(head), dtype=bool)
        joins[:-1] = left[:-1] & ~left[1:] & (name[:-1] > 0) & (name[1:] > 0) & ~begins[1:]
        behind = np.append(False, joins[:-1])[: len(head)]  # the second half of a pair
        alone = ~joins & ~behind & (size > 1) & (name > 0)
        asks = np.flatnonzero(joins | alone)
        other = np.minimum(asks + 1, len(head) - 1)
        pair = joins[asks]
        keys = _keys(name[asks], size[asks], np.where(pair, name[other], np.uint64(0)), np.where(pair, size[other], np.uint64(0)))
        return keys, (head, behind, asks, keys[0])

    def named(self, wanted: tuple, said: np.ndarray) -> Symbols:
        """The parse after the round gave its names; what stands once has none from now on."""
        head, behind, asks, at = wanted
        name = self.name[head]
        name[asks] = said[at]
        return Symbols(name[~behind], self.start[head[~behind]], self.first)

    def aside(self) -> dict[str, np.ndarray]:
        return {**_named(self.name), "step": np.diff(self.start, prepend=0).astype(np.uint32)}


class Words:
    """The words of a batch's texts, for the first round and the result."""

    def __init__(self, batch: Batch):
        self.joined = j = Joined(batch.texts)
        self.first = j.first
        self.own = len(j.word_start) if batch.piece < 0 else int(np.searchsorted(j.word_start, batch.own))

    def keys(self) -> Keys:
        j, raw = self.joined, self.joined.data.tobytes()
        _, first, at, count = np.unique(j.word_hashes(), return_index=True, return_inverse=True, return_counts=True)
        prints = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(j.word_start[first].tolist(), j.word_end[first].tolist(), strict=True))
        one, two = np.frombuffer(prints, "<u8").reshape(-1, 2).T
        return at, mix(one, 59), [one, two >> np.uint64(33) << np.uint64(1) | (count > 1).astype(np.uint64)]


class Parsed:
    """A batch as names of words, and what it asks about its windows given the answers so far."""

    def __init__(self, name: np.ndarray, first: np.ndarray, own: int, window: int):
        self.name, self.window, self.own, self.n = name, window, own, len(name)
        self.stop = np.repeat(first[1:], np.diff(first))  # where each word's document ends
        p = np.arange(own)
        self.p = p[p + window <= self.stop[:own]]  # where windows begin

    @cached_property
    def slices(self) -> tuple[Slices, Slices, np.ndarray]:
        """Two families of hashes of the words' names, and how many words before each stand once in the corpus."""
        mixed = mix(self.name, 58)
        return Slices(mixed), Slices(mixed, 1), np.concatenate([[0], np.cumsum(self.name == 0)])

    def phrases(self, symbols: Symbols) -> tuple[np.ndarray, np.ndarray, Keys]:
        """Where windows begin that strings of symbols hold (from, until), and the strings' keys.

        The string of a symbol goes on until it holds all windows that begin in the symbol or, before a
        symbol without a name or a document's end, as far as it can.
        """
        start, n = symbols.start, self.n
        bounds = np.append(start, n)
        barrier = np.append(start[symbols.name == 0], n)
        stop = np.minimum(self.stop[start], barrier[np.searchsorted(barrier, start)])
        after = np.minimum(bounds[1:], stop)
        end = np.minimum(bounds[np.searchsorted(bounds, after + self.window - 1).clip(0, len(bounds) - 1)], stop)
        until = np.minimum(after, end - self.window + 1)
        ok = (until > start) & (symbols.name > 0) & (start < self.own)
        mixed, first, last = mix(symbols.name, 57), np.flatnonzero(ok), np.searchsorted(bounds, end[ok])
        one, two = Slices(mixed).hash(first, last, 62), Slices(mixed, 1).hash(first, last, 63) >> np.uint64(32)
        return start[ok], until[ok], _keys(one, two)

    def _mark(self, start: np.ndarray, until: np.ndarray) -> np.ndarray:
        edge = np.zeros(self.n + 1, dtype=np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, until, -1)
        return np.cumsum(edge[:-1]) > 0

    def known(self, start: np.ndarray, until: np.ndarray, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows known as repeats, where windows begin that others may be verified against, and which of these are open themselves.

        One occurrence of each string that stands twice stands for the rest of them there.
        """
        shared = (bits & 1 == 1)[at]
        owner = np.zeros(len(at), dtype=bool)
        owner[np.unique(at, return_index=True)[1]] = bits & 2 == 2
        hit, mine = self._mark(start[shared], until[shared]), self._mark(start[shared & owner], until[shared & owner])
        once = self.slices[2]
        p = self.p[(~hit | mine)[self.p]]
        p = p[once[p + self.window] == once[p]]  # a window with a word that stands once is no repeat
        return hit, p, ~hit[p]

    def anchors(self, p: np.ndarray, is_open: np.ndarray) -> Keys:
        """The anchors of the windows at ``p``, whether each stands at two places here, and whether an open window has it."""
        if not len(p):
            return p, np.zeros(0, np.uint64), [np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)]
        x = np.arange(self.n - GRAM + 1)
        gram = self.slices[0].hash(x, x + GRAM, 64)
        width = self.window - GRAM + 1
        low = sliding_min(gram, width)[p]
        new = np.append(True, (low[1:] != low[:-1]) | (np.diff(p) >= width))  # windows far apart have no q-gram in common
        keys, at = np.unique(mix(low[new], 65) >> np.uint64(16), return_inverse=True)
        # occurrences of the anchors inside these windows, not groups of windows, for a periodic text has several in one window
        place = mix(gram, 65) >> np.uint64(16)
        where = np.searchsorted(keys, place).clip(0, len(keys) - 1)
        edge = np.zeros(len(gram) + 1, dtype=np.int64)
        np.add.at(edge, p, 1)
        np.add.at(edge, p + width, -1)
        inside = (np.cumsum(edge[:-1]) > 0) & (keys[where] == place)
        many = np.bincount(where[inside], minlength=len(keys)) > 1
        at = at[np.cumsum(new) - 1]
        wanted = np.zeros(len(keys), dtype=np.uint8)
        np.maximum.at(wanted, at, is_open.astype(np.uint8))
        return at, keys << np.uint64(16), [keys, many.astype(np.uint8), wanted]

    def windows(self, p: np.ndarray) -> Keys:
        one, two, _ = self.slices
        return _keys(one.hash(p, p + self.window, 66), two.hash(p, p + self.window, 67) >> np.uint64(32))


def _named(name: np.ndarray) -> dict[str, np.ndarray]:
    """Names as numbers of distinct ones, which press better."""
    names, of = np.unique(name, return_inverse=True)
    return {"names": names, "of": of.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)}


def _short(at: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """What reads answers later: parts go by the upper half of ``place``."""
    return {"at": at.astype(np.uint32), "place": place >> np.uint64(32) << np.uint64(32)}


def _wanted_elsewhere(got: list[list[np.ndarray]]) -> list[np.ndarray]:
    """1 where an anchor stands at two places and some open window has it."""
    marks = mark_shared([[keys, many] for keys, many, _ in got], 1)
    keys = np.concatenate([g[0] for g in got])
    _, at, _ = distinct(keys)
    wanted = np.zeros(int(at.max(initial=-1)) + 1, dtype=np.uint8)
    np.maximum.at(wanted, at, np.concatenate([g[2] for g in got]))
    cuts = np.cumsum([len(g[0]) for g in got])[:-1]
    return [m & w & 1 for m, w in zip(marks, np.split(wanted[at], cuts), strict=True)]


def _cutter(window: int):
    def cut(text: bytes, limit: int) -> list[tuple[int, int, int]]:
        """Pieces end before a word; the overlap is the words of a window but one."""
        out, a = [], 0
        while a < len(text):
            space = _SPACE.search(text, a + limit)
            word = _WORD.search(text, space.end()) if space else None
            b = word.start() if word else len(text)
            last = b
            for m in islice(_WORD.finditer(text, b), window - 1):
                last = m.end()
            out.append((a, b, last))
            a = b
        return out

    return cut


def dedup_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, limit: int | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: words covered by a window that starts anywhere else too are gone.

    The result reads files in the shared folder; they go with ``shared.workspace`` or ``shared.release``.
    ``limit`` is the bytes of a batch, by the input's size if not given.
    """
    if window < GRAM + 2:
        raise ValueError(f"windows have {GRAM + 2} words at least")
    packed = pack(docs, id_col, text_col, limit, apart=True, cut=_cutter(window))

    def ask_words(batch):
        return [Words(batch).keys()[1:]], None

    words = packed.route(ask_words, lambda part, _, got: name_shared(part, [[one, two >> np.uint32(1), (two & np.uint32(1)).astype(np.uint8)] for one, two in got], 2), [["<u8", "<u4"]], ["u6"], 0.5, "words")

    def parsed(batch: Batch) -> Parsed:
        base = batch.state("round0")
        return Parsed(base["names"][base["of"]], base["first"], int(base["own"][0]), window)

    def symbols_of(batch: Batch, k: int) -> Symbols:
        """The parse that round ``k`` asked about."""
        state, first = batch.state(f"round{k}"), batch.state("round0")["first"]
        name = state["names"][state["of"]]
        return Symbols(name, np.cumsum(state["step"], dtype=np.int64) if k else np.arange(len(name)), first)

    told = None
    for k in range(ROUNDS):

        def ask_symbols(batch, k=k, told=told):
            if k == 0:
                own = Words(batch)
                at, place, _ = own.keys()
                name = words(batch, place)[0][at]
                symbols, state = Symbols(name, np.arange(len(name)), own.first), {"first": own.first, "own": np.array([own.own]), **_named(name)}
            else:
                symbols = symbols_of(batch, k - 1)
                (_, place, _), wanted = symbols.wanted(k - 1)
                symbols = symbols.named(wanted, told(batch, place)[0])
                state = symbols.aside()
            return [symbols.wanted(k)[0][1:]], state

        kinds = ["u6", "<u4", "u6", "<u4", "u1"]
        told = packed.route(ask_symbols, lambda part, _, got: name_shared(part, got, 4), [kinds], ["u6"], 0.6 * 0.75**k, f"round{k}")
        if k > 1:
            packed.forget(f"round{k - 1}")

    def ask_phrases(batch, told=told):
        symbols = symbols_of(batch, ROUNDS - 1)
        (_, place, _), wanted = symbols.wanted(ROUNDS - 1)
        start, until, (at, place, columns) = parsed(batch).phrases(symbols.named(wanted, told(batch, place)[0]))
        return [(place, columns)], {"start": start.astype(np.uint32), "until": until.astype(np.uint32), **_short(at, place)}

    phrases = packed.route(ask_phrases, lambda part, _, got: mark_shared(got, 2), [["<u8", "<u4", "u1"]], ["u1"], 0.4, "phrases")
    packed.forget(f"round{ROUNDS - 1}")

    def ask_anchors(batch):
        x, before = parsed(batch), batch.state("phrases")
        hit, p, is_open = x.known(before["start"], before["until"], before["at"].astype(np.int64), phrases(batch, before["place"])[0])
        at, place, columns = x.anchors(p, is_open)
        return [(place, columns)], {"hit": np.packbits(hit), "p": p.astype(np.uint32), **_short(at, place)}

    grams = packed.route(ask_anchors, lambda part, _, got: _wanted_elsewhere(got), [["u6", "u1", "u1"]], ["u1"], 0.1, "grams")
    packed.forget("phrases")

    def ask_windows(batch):
        before = batch.state("grams")
        p = before["p"].astype(np.int64)
        p = p[(grams(batch, before["place"])[0] == 1)[before["at"]]] if len(p) else p
        at, place, columns = parsed(batch).windows(p)
        return [(place, columns)], {"hit": before["hit"], "p": p.astype(np.uint32), **_short(at, place)}

    last = packed.route(ask_windows, lambda part, _, got: mark_shared(got, 2), [["<u8", "<u4", "u1"]], ["u1"], 0.3, "windows")
    packed.forget("grams")

    def gone(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """The documents' first words, and which words some repeated window covers."""
        base, before = batch.state("round0"), batch.state("windows")
        first, own = base["first"], int(base["own"][0])
        n = int(first[-1])
        hit = np.unpackbits(before["hit"], count=n).astype(bool)
        hit[before["p"][(last(batch, before["place"])[0] & 1 == 1)[before["at"]]]] = True
        hit[own:] = False
        p = np.flatnonzero(hit)
        edge = np.zeros(n + 1, dtype=np.int64)
        edge[p] += 1
        edge[p + window] -= 1
        return first, np.cumsum(edge[:-1]) > 0

    names = ["doc_id", "n_words", "n_removed", "text"]

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(it):
            first, mask = gone(batch)
            rows = [_kept(text.split(), mask[first[d] : first[d + 1]]) for d, text in enumerate(batch.texts)]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(batch.ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:2]), pa.array(cols[2], pa.binary()).cast(pa.string())], names=names)

    def finish_piece(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(it):
            _, mask = gone(batch)
            columns = [pa.array([batch.row["row"]], pa.int64()), pa.array([batch.piece], pa.int32()), pa.array(batch.ids, pa.int64()), pa.array([batch.raw[: batch.own]], pa.binary()), pa.array([mask.astype(np.uint8).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "piece", "doc_id", "data", "mask"])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        words, masks = [], []
        for own, mask in zip(table.column("data").to_pylist(), table.column("mask").to_pylist(), strict=True):
            masks.append((len(words), np.frombuffer(mask, np.uint8).astype(bool)))
            words += own.split()
        some = np.zeros(len(words) + window, dtype=bool)
        for at, mask in masks:
            some[at : at + len(mask)] |= mask
        *counts, kept = _kept(words, some[: len(words)])
        return pa.table([table.column("doc_id")[:1], *(pa.array([c], pa.int64()) for c in counts), pa.array([kept], pa.binary()).cast(pa.string())], names=names)

    schema = "doc_id long, n_words long, n_removed long, text string"
    ready = packed.answered()
    out = ready.where("piece < 0").mapInArrow(finish, schema)
    if packed.n_pieces:
        pieces = ready.where("piece >= 0").mapInArrow(finish_piece, "row long, piece int, doc_id long, data binary, mask binary")
        out = out.unionByName(pieces.groupBy("row").applyInArrow(whole, schema))
    return out


def _kept(words: list[bytes], gone: np.ndarray) -> tuple[int, int, bytes]:
    """Words, removed ones, and what is left."""
    n = int(gone.sum())
    return len(words), n, b" ".join(compress(words, (~gone).tolist()) if n else words)
