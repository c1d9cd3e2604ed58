"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts and items are lower-cased (A-Z) and cut into words of digits, letters and anything outside
ASCII.  Each distinct item word is a symbol of two or three characters of a small alphabet (the automaton's
nodes look through their edges one by one), so it has far fewer nodes than bytes; it
holds every window of ``WINDOW`` item words (a shorter item is one window) and reads each text once, as
the symbols of its words.  Hits are mapped back to byte offsets in the original text.

An automaton has at most ``NODES`` nodes, some 100 bytes each in a worker.  The items of a larger
benchmark make several: they are streamed through the driver one block at a time into files in the
shared folder, and a task keeps ``CHUNK_BYTES`` of texts at a time and reads them with one automaton
after the other.  There is one scan of the documents and no shuffle whatever the benchmark's size.

Cases: null or wordless texts and items have no words, so no hits; items that share an id are one, a
null id is the empty string; windows that several items share name all of them; an empty benchmark hits
nothing; rows with the same id stay separate rows and equal rows have equal results; an empty table
gives none; columns besides the id and the text are not looked at, and ``clean`` keeps them as they are;
a very long text is read whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from tessera.llm.exchange import texts_of
from tessera.llm.hashing import word_spans
from tessera.llm.shared import column, fresh_dir, narrow, open_store, size_batches, trim

WINDOW = 10
#: Characters of a symbol's place.
BASE = 64
#: Nodes of one automaton at most, counting each window's words as if none were shared.
NODES = 2_000_000
#: Bytes of texts that a task keeps while it reads them with several automata.
CHUNK_BYTES = 32 << 20

_ASCII_WORD = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)}
IS_WORD = np.array([b >= 0x80 or b in _ASCII_WORD for b in range(256)])
#: Lower-cases A-Z and blanks what is no word byte; offsets stay.
NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if IS_WORD[b] else 0x20 for b in range(256))

Items = list[tuple[str, bytes]]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def n_nodes(text: bytes, size: int = WINDOW) -> int:
    """Nodes of an item's windows at most, with symbols of three characters."""
    n = len(words_of(text))
    return 3 * (n if n <= size else (n - size + 1) * size)


class Machine:
    """The automaton over item windows: strings of word symbols, with the items that own each."""

    def __init__(self, items: Items, size: int = WINDOW):
        texts = [(item, words_of(text)) for item, text in items]
        number: dict[bytes, int] = {}
        for _, words in texts:
            for w in words:
                number.setdefault(w, len(number))
        self.width = 1
        while BASE**self.width < len(number):
            self.width += 1
        self.symbol = {w: self._symbol(n) for w, n in number.items()}
        self.other = "\0" * self.width
        owners: dict[str, set[str]] = {}
        for item, words in texts:
            flat = "".join([self.symbol[w] for w in words])
            for i in range(max(1, len(words) - size + 1) if words else 0):
                owners.setdefault(flat[i * self.width : (i + size) * self.width], set()).add(item)
        same: dict[frozenset, tuple[str, ...]] = {}
        self.owners = [same.setdefault(frozenset(ids), tuple(sorted(ids))) for ids in owners.values()]
        self.sizes = [len(w) // self.width for w in owners]
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, w in enumerate(owners):
                self.automaton.add_word(w, k)
            self.automaton.make_automaton()

    def _symbol(self, n: int) -> str:
        """A number's digits, each place with characters of its own, so that no hit begins inside a symbol; NUL stands for other words."""
        return "".join([chr(1 + BASE * k + n // BASE**k % BASE) for k in range(self.width)])

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """(first word of each hit, words of each hit, items that occur)."""
        if self.automaton is None or not words:
            return [], [], set()
        get, other, first, sizes, items = self.symbol.get, self.other, [], [], set()
        for end, k in self.automaton.iter("".join([get(w, other) for w in words])):
            first.append((end + 1) // self.width - self.sizes[k])
            sizes.append(self.sizes[k])
            items.update(self.owners[k])
        return first, sizes, items


def cover(n: int, first: list[int], size: list[int]) -> np.ndarray:
    """Which of ``n`` words some hit covers."""
    edge = np.zeros(n + 1, dtype=np.int64)
    first = np.array(first, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + np.array(size, dtype=np.int64), -1)
    return np.cumsum(edge[:-1]) > 0


def spans(text: bytes, hit: np.ndarray) -> list[list[int]]:
    """Byte offsets in the original text of the runs of hit words."""
    if not hit.any():
        return []
    start, end = word_spans(np.frombuffer(text, dtype=np.uint8), IS_WORD)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [[int(start[a]), int(end[b - 1])] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int, nodes: int) -> Iterator[Items]:
    """The items in blocks for one automaton each, streamed through the driver; no block at all holds windows if none of the items does."""
    block, have = [], 0
    rows = benchmark.select(column(benchmark, item_col).cast("string").alias("i"), column(benchmark, text_col).cast("string").alias("t"))
    for row in rows.where("t is not null").toLocalIterator():
        for text in _split(row["t"].encode(), size, nodes):
            n = n_nodes(text, size)
            if block and have + n > nodes:
                yield block
                block, have = [], 0
            block.append(("" if row["i"] is None else row["i"], text))
            have += n
    yield block


def _split(text: bytes, size: int, nodes: int) -> list[bytes]:
    """An item too long for one automaton in pieces that overlap by a window less a word."""
    if n_nodes(text, size) <= nodes:
        return [text]
    words, step = words_of(text), max(1, nodes // (3 * size))
    return [b" ".join(words[a : a + step + size - 1]) for a in range(0, len(words) - size + 1, step)]


_built: dict[str, object] = {}


def _cached(shared, size: int) -> Machine:
    """The automaton of a broadcast, built once in each worker."""
    if _built.get("of") is not shared or _built["size"] != size:
        _built.clear()
        _built.update({"of": shared, "size": size, "machine": Machine(shared.value, size)})
    return _built["machine"]


def _read(folder: str, n: int, size: int) -> Iterator[Machine]:
    """The automata of the blocks in a folder, one at a time."""
    _built.clear()
    for k in range(n):
        store, path = open_store(folder)
        with store.open_input_file(f"{path}/{k}") as f:
            yield Machine(pickle.loads(zstandard.ZstdDecompressor().decompress(f.read())), size)
        trim()


def _machines(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, size: int, nodes: int) -> tuple[Callable[[], Iterator[Machine]], bool]:
    """What gives a worker the automata one by one, and whether there are several."""
    blocks = _blocks(benchmark, item_col, text_col, size, nodes)
    one, two = next(blocks), next(blocks, None)
    if two is None:
        shared = spark.sparkContext.broadcast(one)

        return lambda: iter([_cached(shared, size)]), False
    folder, n = fresh_dir(spark, "benchmark"), 0
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    for block in _chain(one, two, blocks):
        with store.open_output_stream(f"{path}/{n}") as out:
            out.write(zstandard.ZstdCompressor().compress(pickle.dumps(block)))
        n += 1

    return lambda: _read(folder, n, size), True


def _chain(one: Items, two: Items, rest: Iterator[Items]) -> Iterator[Items]:
    yield one
    yield two
    yield from rest


def _chunks(it: Iterator[pa.RecordBatch], several: bool) -> Iterator[list[pa.RecordBatch]]:
    """Batches to read with all automata before the next ones; one by one where there is one automaton."""
    some, size = [], 0
    for b in it:
        some.append(b)
        size += b.nbytes
        if not several or size >= CHUNK_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<long>>"


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, nodes: int = NODES
) -> DataFrame:
    """Per document: words, hit words, the items found, and the hit byte spans of the original text; one scan, no shuffle."""
    machines, several = _machines(docs.sparkSession, benchmark, item_col, item_text_col, window, nodes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(it, several):
            found = [[([], [], set()) for _ in range(b.num_rows)] for b in chunk]
            counts = [[0] * b.num_rows for b in chunk]
            for machine in machines():
                for b, hits, count in zip(chunk, found, counts, strict=True):
                    for i, text in enumerate(texts_of(b.column("text"))):
                        words = words_of(text)
                        count[i] = len(words)
                        for all_, some in zip(hits[i][:2], (got := machine.scan(words))[:2], strict=True):
                            all_ += some
                        hits[i][2].update(got[2])
            for b, hits, count in zip(chunk, found, counts, strict=True):
                cols: list[list] = [count, [], [], []]
                texts = b.column("text")
                for i, (first, size, items) in enumerate(hits):
                    mask = cover(count[i], first, size) if first else np.zeros(0, dtype=bool)
                    cols[1].append(int(mask.sum()))
                    cols[2].append(sorted(items))
                    cols[3].append(spans(texts[i].as_py().encode(), mask) if first else [])
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return narrow(docs, id_col, text_col).mapInArrow(run, RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, nodes: int = NODES) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns; one scan, no shuffle."""
    size_batches(docs.sparkSession)
    names, schema, at = docs.columns, docs.schema, docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names with dots are no names for a plan's columns
    machines, several = _machines(docs.sparkSession, benchmark, item_col, item_text_col, window, nodes)
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(it, several):
            kept = [np.ones(b.num_rows, dtype=bool) for b in chunk]
            for machine in machines():
                for b, keep in zip(chunk, kept, strict=True):
                    for i, text in enumerate(texts_of(b.column(at))):
                        keep[i] = keep[i] and not machine.scan(words_of(text))[0]
            for b, keep in zip(chunk, kept, strict=True):
                if b.num_rows:
                    yield b.filter(pa.array(keep))

    return plain.mapInArrow(run, StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema)])).toDF(*names)
