"""Line dedup through sharded minimal perfect hashes over distinct line hashes.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  Keys of at least
``MIN_CHARS`` code points that occur in two or more documents stay in the smallest document id only.
The distinct line hashes of a shard get a minimal perfect hash; arrays beside it hold a fingerprint,
the count of documents, and the smallest and largest id per slot, and the documents' packed hashes
probe those arrays.  A line that half of all documents hold is one entry per batch of documents.  Lines
are told apart by 128 bits: 64 are looked up, 64 are the fingerprint, and lines that agree in the first
only have slots of their own in a second perfect hash.

Cases: a null or empty text is one empty line; lines with short or blank keys always stay; a line
repeated in one document only stays as often as it stands there; rows with the same id count as one
document; a null id sorts last; equal rows have equal results; an empty table gives none; other columns,
whatever their names, come through ``with_unique_lines`` as they are; a very long text is one batch and
is held whole, as its row is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.exchange import batch_rows, distinct, id_array, joined, pack
from tessera.llm.hashing import PerfectHash, mix
from tessera.llm.shared import column

MIN_CHARS = 10


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def eligible(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least)


def _lines(ids: list, texts: list[bytes], least: int):
    """(ids, document of each eligible line, its line number, its two hashes)."""
    doc, number, prints = [], [], []
    for d, text in enumerate(texts):
        for n, line in enumerate(text.split(b"\n")):
            key = line_key(line)
            if eligible(key, least):
                doc.append(d)
                number.append(n)
                prints.append(xxhash.xxh3_128_digest(key))
    hashes = np.frombuffer(b"".join(prints), dtype="<u8").reshape(-1, 2)
    return id_array(ids), np.array(doc, dtype=np.int64), np.array(number, dtype=np.int64), hashes


def _ask(ids: list, texts: list[bytes], least: int):
    """The batch's distinct lines: hash, fingerprint, smallest and largest id, and number of documents."""
    who, doc, number, hashes = _lines(ids, texts, least)
    first, at, _ = distinct(hashes[:, 0], hashes[:, 1])
    low = np.full(len(first), np.iinfo(np.int64).max)
    high = np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(low, at, who[doc])
    np.maximum.at(high, at, who[doc])
    each, _, _ = distinct(at, who[doc])
    count = np.bincount(at[each], minlength=len(first))
    keys = hashes[first, 0]
    return who, doc, number, mix(keys, 51), at, [keys, hashes[first, 1], low, high, count]


class Counts:
    """A shard's arrays: a perfect hash of its distinct line hashes and, per slot, a fingerprint, a count of documents and their smallest and largest id.

    Where several lines have one hash, the second and further ones have a hash mixed with their fingerprint in a perfect hash of their own.
    """

    def __init__(self, keys: np.ndarray, prints: np.ndarray):
        first, _, _ = distinct(keys, prints)
        keys, prints = keys[first], prints[first]
        more = np.append(False, keys[1:] == keys[:-1])[: len(keys)]
        self.index, self.more = PerfectHash(keys[~more]), PerfectHash(self._both(keys[more], prints[more]))
        n = len(keys)
        self.prints, self.count = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        self.low, self.high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        self.prints[self.index.slot(keys[~more])] = prints[~more]
        self.prints[self.index.n + self.more.slot(self._both(keys[more], prints[more]))] = prints[more]

    @staticmethod
    def _both(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return mix(keys ^ mix(prints, 53), 54)

    def slot(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The slot of each line; every line must be one of the shard's."""
        slot = self.index.slot(keys)
        other = self.prints[slot] != prints
        slot[other] = self.index.n + self.more.slot(self._both(keys[other], prints[other]))
        return slot

    def add(self, keys: np.ndarray, prints: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        slot = self.slot(keys, prints)
        np.add.at(self.count, slot, count.astype(np.int64))
        np.minimum.at(self.low, slot, low)
        np.maximum.at(self.high, slot, high)

    def probe(self, keys: np.ndarray, prints: np.ndarray, low: np.ndarray) -> np.ndarray:
        """1: several documents have the line (rows with one id are one); 2 more: the smallest id asked for is the smallest of all."""
        slot = self.slot(keys, prints)
        several = (self.count[slot] > 1) & (self.low[slot] != self.high[slot])
        return several.astype(np.uint8) | (self.low[slot] == low).astype(np.uint8) << 1


def _answer(got: list[list[np.ndarray]]) -> list[np.ndarray]:
    (keys, prints, *_), _ = joined(got)
    table = Counts(keys, prints)
    for some in got:
        table.add(*some)
    return [table.probe(k, p, low) for k, p, low, _, _ in got]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``, one row per input row, with the lines that stay."""
    return _dedup(docs, id_col, text_col, least, [])


def with_unique_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", least: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``docs`` with the lines that stay as the text, and their length in ``size_col`` where there is one.

    A null text comes back empty.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    plain = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"), *(column(docs, c).alias(f"c{i}") for i, c in enumerate(others)))
    out = _dedup(plain, "doc_id", "text", least, plain.columns[2:])
    new = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: F.col("text"), size_col: F.char_length("text").cast("long")}
    return out.select(*((new[c] if c in new else F.col(f"rest.c{others.index(c)}")).alias(c) for c in docs.columns))


def _dedup(docs: DataFrame, id_col: str, text_col: str, least: int, others: list[str]) -> DataFrame:
    packed = pack(docs, id_col, text_col, keep=others, apart=True)

    def ask(batch):
        _, _, _, place, _, columns = _ask(batch.ids, batch.texts, least)
        return [(place, columns)], None

    told = packed.route(ask, lambda part, _, got: _answer(got), [["<u8", "<u8", "<i8", "<i8", "<u4"]], ["u1"], 0.4, "lines")

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(it):
            ids, texts = batch.ids, batch.texts
            who, doc, number, place, at, columns = _ask(ids, texts, least)
            (bits,) = told(batch, place)
            low = np.where(bits & 2, columns[2], np.iinfo(np.int64).min)  # elsewhere no id of this batch is the smallest
            drop = (bits[at] & 1 == 1) & (who[doc] != low[at]) if len(doc) else np.zeros(0, bool)
            gone: dict[int, set[int]] = {}
            for d, n in zip(doc[drop].tolist(), number[drop].tolist(), strict=True):
                gone.setdefault(d, set()).add(n)
            kept, n_lines = [], []
            for d, text in enumerate(texts):
                n_lines.append(text.count(b"\n") + 1)
                if d in gone:
                    text = b"\n".join(x for n, x in enumerate(text.split(b"\n")) if n not in gone[d])
                kept.append(text)
            made = [pa.array(ids, pa.int64()), pa.array(n_lines, pa.int64()), pa.array([len(gone.get(d, ())) for d in range(len(ids))], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*made, *([batch.row["rest"]] if others else [])], names=["doc_id", "n_lines", "n_dropped", "text", *(["rest"] if others else [])])

    schema = "doc_id long, n_lines long, n_dropped long, text string"
    if others:
        schema += f", rest {packed.batches.schema['rest'].dataType.elementType.simpleString()}"
    return packed.answered().mapInArrow(finish, schema)
