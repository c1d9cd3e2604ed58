"""Packed routing of keys between batches of texts and the parts that own them.

Rows per word or per byte position would swamp a shuffle, so texts are packed into batches and what a
batch asks about (each distinct key once) travels as arrays, one row for each batch and part.  The part
that owns a range of keys answers every batch in the order asked.  A batch's answers go to a file in the
shared folder and only their place travels on, so that later rounds join light rows.  A key occurs at
most once per batch, so a frequent word, line or passage adds no more rows or bytes to its part than any
other.

Batches and parts grow with the square root of the input (``batch_bytes``), so that a row between a
batch and a part holds some twenty keys at any size: 1 MB to some 30 GB, 6 MB at 1 TB, 64 MB at 100 TB.
A text longer than a batch is cut into pieces that overlap, where the operator says how.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import column, drop_folder, durable, free, fresh_dir, has_store, narrow, open_store, parts_for, trim

#: Bytes of text in a batch, at least and at most.
BATCH_BYTES, MOST_BYTES = 1 << 20, 64 << 20
#: Bytes of keys in a part, at least; parts grow like batches.
PART_BYTES = 12 << 20

BATCH_SCHEMA = "batch long, ids array<long>, sizes array<long>, blob binary, place string, n_bytes long, row long, piece int, own long"

#: Where a long text is cut: (text, bytes) to (start, end of what is the piece's own, end with the overlap) of each piece.
Cutter = Callable[[bytes, int], list[tuple[int, int, int]]]


def batch_bytes(n_bytes: float) -> int:
    """Bytes of text in a batch for an input of ``n_bytes``."""
    return int(min(MOST_BYTES, max(BATCH_BYTES, (40 * n_bytes) ** 0.5)))


def input_bytes(docs: DataFrame) -> float:
    """Spark's estimate of a frame's size; 0 where it has none."""
    size = float(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1e17 else 0.0


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def grouped(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of about ``limit`` bytes at a time."""
    for ids, texts, _ in grouped_rows(batches, limit):
        yield ids, texts


def grouped_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes], list]]:
    """(ids, texts, what else there is in the rows) of about ``limit`` bytes at a time."""
    ids, texts, more, size = [], [], [], 0
    for b in batches:
        rest = b.column("rest").to_pylist() if "rest" in b.schema.names else [None] * b.num_rows
        for i, t, r in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), rest, strict=True):
            if texts and size + len(t) > limit:
                yield ids, texts, more
                ids, texts, more, size = [], [], [], 0
            ids.append(i)
            texts.append(t)
            more.append(r)
            size += len(t) + 16
    if texts:
        yield ids, texts, more
    trim()


class Blobs:
    """One file of this task attempt for blobs; opened at the first one."""

    def __init__(self, folder: str):
        self.folder, self.out, self.at, self.name = folder, None, 0, ""

    def put(self, blob: bytes) -> str:
        """Where the blob is from now on."""
        if self.out is None:
            task = TaskContext.get()
            self.name = f"{self.folder}/{task.partitionId()}-{task.taskAttemptId()}"
            store, path = open_store(self.name)
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.out = store.open_output_stream(path)
        self.out.write(blob)
        self.at += len(blob)
        return f"{self.at - len(blob)}:{len(blob)}:{self.name}"

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def fetch(place: str, blob: bytes) -> bytes:
    if not place:
        return blob
    start, size, name = place.split(":", 2)
    store, path = open_store(name)
    with store.open_input_file(path) as f:
        return f.read_at(int(size), int(start))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None, keep: list[str] = (), apart: bool = False, cut: Cutter | None = None) -> Packed:
    """Durable batches of compressed texts; null texts become empty, null ids stay null.

    Columns named in ``keep`` travel along as ``rest``, an array of structs.  With ``apart`` the
    compressed texts go to files in the shared folder and the rows hold their place there, so that
    several rounds of answers can join the batches without shuffling texts; ``shared.release``
    removes the files.  A file's name has its task attempt in it, and rows name the attempt that
    made them.  With ``cut`` each piece of a text longer than ``limit`` is a batch of its own: ``row``
    is its text's number, ``piece`` its place there (else -1), ``own`` the bytes without the overlap.
    """
    limit = limit or batch_bytes(input_bytes(docs))
    apart = apart and has_store(docs.sparkSession)
    folder = fresh_dir(docs.sparkSession, "texts") if apart else ""
    rows = narrow(docs, id_col, text_col)
    if keep:
        rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"), F.struct(*(column(docs, c) for c in keep)).alias("rest"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, k, kind, blobs = zstandard.ZstdCompressor(level=1), 0, None, Blobs(folder)

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in it:
                kind = b.schema.field("rest").type if keep else None
                yield b

        for ids, texts, more in grouped_rows(typed(), limit):
            pieces = cut(texts[0], limit) if cut and len(texts) == 1 and len(texts[0]) > limit else []
            row = TaskContext.get().partitionId() << 32 | k
            for n, (start, own, end) in enumerate(pieces or [(0, 0, 0)]):
                some = [texts[0][start:end]] if pieces else texts
                raw = b"".join(some)
                blob, place = squeeze.compress(raw), ""
                if apart:
                    place, blob = blobs.put(blob), b""
                columns = [
                    pa.array([TaskContext.get().partitionId() << 32 | k], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in some]], pa.list_(pa.int64())),
                    pa.array([blob], pa.binary()),
                    pa.array([place], pa.string()),
                    pa.array([len(raw)], pa.int64()),
                    pa.array([row], pa.int64()),
                    pa.array([n if pieces else -1], pa.int32()),
                    pa.array([own - start if pieces else len(raw)], pa.int64()),
                ]
                if keep:
                    columns.append(pa.array([more], pa.list_(kind)))
                yield pa.RecordBatch.from_arrays(columns, names=["batch", "ids", "sizes", "blob", "place", "n_bytes", "row", "piece", "own", *(["rest"] if keep else [])])
                k += 1
        blobs.close()

    schema = BATCH_SCHEMA + (f", rest array<{rows.schema['rest'].dataType.simpleString()}>" if keep else "")
    return Packed(durable(rows.mapInArrow(run, schema)))


class Batch:
    """A row of packed batches in a task; texts are unpacked when they are asked for."""

    def __init__(self, row: dict):
        self.row, self.ids, self.sizes = row, row["ids"], row["sizes"]
        self.number, self.piece, self.own = row["batch"], row["piece"], row["own"]

    @cached_property
    def raw(self) -> bytes:
        """The texts end to end."""
        return zstandard.ZstdDecompressor().decompress(fetch(self.row["place"], self.row["blob"]), max_output_size=max(1, sum(self.sizes)))

    @cached_property
    def texts(self) -> list[bytes]:
        at = np.concatenate([[0], np.cumsum(self.sizes)]).tolist()
        return [self.raw[at[i] : at[i + 1]] for i in range(len(self.sizes))]

    def state(self, name: str) -> dict[str, np.ndarray]:
        """What the batch put aside in the round ``name``."""
        got = self.row[f"{name}_state"]
        return pickle.loads(zstandard.ZstdDecompressor().decompress(fetch(got[1:].decode(), b"") if got[:1] == b"@" else got[1:]))


NO_ID = np.iinfo(np.int64).max


def id_array(ids: list) -> np.ndarray:
    """Ids as integers; a null id sorts last."""
    return np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)


def batch_rows(it: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    """The rows of packed batches with their answers."""
    for b in it:
        names = [n for n in b.schema.names if n != "rest"]
        for i in range(b.num_rows):
            row = {n: b.column(n)[i].as_py() for n in names}
            if "rest" in b.schema.names:
                row["rest"] = b.column("rest")[i].values
            yield Batch(row)
    trim()


def split(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys by part, and where each part begins in it."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


#: What deals the entries to parts (well-mixed 64-bit numbers), and the columns that travel.
Channel = tuple[np.ndarray, list[np.ndarray]]


def _size(width: str) -> int:
    """Bytes of a column's entries: ``u6`` holds numbers below 2**48, other widths are dtypes."""
    return 6 if width == "u6" else np.dtype(width).itemsize


def _encode(column: np.ndarray, width: str) -> bytes:
    if width == "u6":
        return np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return column.astype(width).tobytes()


def _decode(raw: bytes, width: str, count: int, at: int) -> np.ndarray:
    if width == "u6":
        out = np.zeros((count, 8), dtype=np.uint8)
        out[:, :6] = np.frombuffer(raw, np.uint8, 6 * count, at).reshape(-1, 6)
        return out.view("<u8").ravel()
    return np.frombuffer(raw, dtype=width, count=count, offset=at)


@dataclass(frozen=True)
class Told:
    """Reads a batch's answers, by channel and in the order of its keys."""

    name: str
    parts: int
    back: tuple[str, ...]

    def __call__(self, batch: Batch, *channels: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(len(keys), dtype="<u8" if w == "u6" else w) for keys, w in zip(channels, self.back, strict=True)]
        raw = fetch(batch.row[f"{self.name}_place"] or "", batch.row[f"{self.name}_blob"] or b"")
        if raw:
            unzip = zstandard.ZstdDecompressor()
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            part, size = np.frombuffer(raw, "<i4", n, 8), np.frombuffer(raw, "<i8", n, 8 + 4 * n)
            start = 8 + 12 * n + np.cumsum(size) - size
            places = [split(keys, self.parts) for keys in channels]
            for p, begin, n in zip(part.tolist(), start.tolist(), size.tolist(), strict=True):
                bits, at = unzip.decompress(raw[begin : begin + n]), 0
                for o, w, (order, bound) in zip(out, self.back, places, strict=True):
                    count = int(bound[p + 1] - bound[p])
                    o[order[bound[p] : bound[p + 1]]] = _decode(bits, w, count, at)
                    at += count * _size(w)
        return out


class Packed:
    """Batches of texts, and the places of the answers that they have got so far."""

    def __init__(self, batches: DataFrame):
        self.batches = batches
        row = batches.agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("piece") >= 0).alias("pieces")).first()
        self.n_bytes, self.n_batches, self.n_pieces = row["bytes"] or 0, row["rows"], row["pieces"]
        self.spread = batches  # as they were read
        self.aside: dict[str, str] = {}

    def forget(self, *names: str) -> None:
        """Remove what batches put aside in rounds that nothing asks for any more."""
        for name in names:
            if self.aside[name]:
                drop_folder(self.aside[name])

    def answered(self) -> DataFrame:
        """Batches beside their answers, spread by their texts' size: a row is light, but what stands behind it is not."""
        return self.spread

    def route(
        self,
        ask: Callable[[Batch], tuple[list[Channel], dict[str, np.ndarray] | None]],
        answer: Callable[[int, int, list[list[np.ndarray]]], list[np.ndarray]],
        widths: list[list[str]],
        back: list[str],
        key_bytes_per_byte: float,
        name: str,
    ) -> Told:
        """A round: all batches ask, and get the places of their answers (``<name>_place``, ``<name>_blob``) as columns; gives what reads them.

        ``ask(batch)`` gives for each channel the distinct keys and the columns that travel with them
        (dtypes ``widths``), and what the batch puts aside for later rounds, in a file of its own whose
        place travels (``Batch.state``).  ``answer(part, channel, got)`` gets each asking batch's columns
        in the order of the batches' numbers, however rows arrive, and gives each batch an array of
        ``back``'s dtype, one for each entry.  ``ask`` must give the same entries in the same order
        wherever it runs; a part that is answered again gives the same answers.
        """
        rows, told, self.aside[name] = _route(self.spread, self.n_bytes, ask, answer, widths, back, key_bytes_per_byte, name)
        self.batches = durable(self.batches.join(rows, self.batches["batch"] == rows["to"], "left").drop("to"))
        del rows
        free(self.batches.sparkSession)
        parts = min(self.n_batches, parts_for(self.batches.sparkSession, self.n_bytes, 4 * batch_bytes(self.n_bytes)))
        # by a hash, for Spark leaves out a repartition by what a join has dealt by, and then merges the light rows into few tasks
        self.spread = self.batches.repartition(max(1, parts), F.xxhash64("batch"))
        return told


def _route(batches: DataFrame, total: int, ask, answer, widths: list[list[str]], back: list[str], key_bytes_per_byte: float, name: str) -> tuple[DataFrame, Told, str]:
    spark = batches.sparkSession
    parts = parts_for(spark, total * key_bytes_per_byte, max(PART_BYTES, 4 * batch_bytes(total)))
    folder, aside_folder = (fresh_dir(spark, name), fresh_dir(spark, f"{name}-aside")) if has_store(spark) else ("", "")

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aside, squeeze = Blobs(aside_folder), zstandard.ZstdCompressor(level=1)
        for batch in batch_rows(it):
            columns, bounds = [], []
            channels, state = ask(batch)
            for (keys, some), kinds in zip(channels, widths, strict=True):
                order, at = split(keys, parts)
                columns.append([(_encode(c[order], w), _size(w)) for c, w in zip(some, kinds, strict=True)])
                bounds.append(at)
            bounds = np.array(bounds)
            counts = np.diff(bounds, axis=1)
            full = np.flatnonzero(counts.sum(axis=0)).tolist()
            rows = [counts[:, p].astype("<i8").tobytes() + b"".join(c[bounds[k, p] * n : bounds[k, p + 1] * n] for k, some in enumerate(columns) for c, n in some) for p in full]
            if state is not None:
                blob = squeeze.compress(pickle.dumps(state))
                rows.append(b"@" + aside.put(blob).encode() if aside_folder else b"=" + blob)
                full.append(-1 - batch.number % parts)
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([batch.number] * len(full), pa.int64()), pa.array(rows, pa.binary())], names=["part", "batch", "entries"])
        aside.close()

    def resolve(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:  # the places of what batches put aside
            return table.rename_columns(["part", "batch", "bits"])
        table, squeeze = table.sort_by("batch"), zstandard.ZstdCompressor(level=1)
        got: list[list[list[np.ndarray]]] = [[] for _ in widths]
        for raw in table.column("entries").to_pylist():
            counts, at = np.frombuffer(raw, "<i8", len(widths)).tolist(), 8 * len(widths)
            for channel, n, kinds in zip(got, counts, widths, strict=True):
                channel.append([])
                for w in kinds:
                    channel[-1].append(_decode(raw, w, n, at))
                    at += n * _size(w)
        part = table.column("part")[0].as_py()
        said = [answer(part, k, some) for k, some in enumerate(got)]
        bits = [squeeze.compress(b"".join(_encode(said[k][i], w) for k, w in enumerate(back))) for i in range(table.num_rows)]
        return pa.table({"part": table.column("part"), "batch": table.column("batch"), "bits": pa.array(bits, pa.binary())})

    def store(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = Blobs(folder)
        for b in it:
            for to, said in zip(b.column("to").to_pylist(), b.column("said").to_pylist(), strict=True):
                state = [x["bits"] for x in said if x["part"] < 0]
                said = sorted((x for x in said if x["part"] >= 0), key=lambda x: x["part"])
                n = len(said)
                blob = np.array([n], "<i8").tobytes() + np.array([x["part"] for x in said], "<i4").tobytes() + np.array([len(x["bits"]) for x in said], "<i8").tobytes() + b"".join(x["bits"] for x in said)
                place = blobs.put(blob) if folder else ""
                columns = [pa.array([to], pa.int64()), pa.array([place], pa.string()), pa.array([None if folder else blob], pa.binary()), pa.array([state[0] if state else None], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["to", f"{name}_place", f"{name}_blob", f"{name}_state"])
        blobs.close()

    sent = batches.mapInArrow(send, "part int, batch long, entries binary")
    told = sent.groupBy("part").applyInArrow(resolve, "part int, batch long, bits binary")
    by_batch = told.groupBy(F.col("batch").alias("to")).agg(F.collect_list(F.struct("part", "bits")).alias("said"))
    return by_batch.mapInArrow(store, f"to long, {name}_place string, {name}_blob binary, {name}_state binary"), Told(name, parts, tuple(back)), aside_folder


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows given by columns: where each distinct one first stands (in sorted order), each row's number, and counts."""
    if len(columns) == 1:
        _, first, at, count = np.unique(columns[0], return_index=True, return_inverse=True, return_counts=True)
        return first, at, count
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), dtype=bool)
    for k, c in enumerate(columns):
        c = c[order]
        new[1:] = new[1:] | (c[1:] != c[:-1]) if k else c[1:] != c[:-1]
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return order[begin], at, np.diff(np.append(begin, len(order)))


def joined(got: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """The batches' columns end to end, and where to split what is made of them."""
    return [np.concatenate(c) for c in zip(*got, strict=True)], np.cumsum([len(g[0]) for g in got])[:-1]


#: Names have a part number and a number within the part: 2**47 in all, so that a flag goes beside them in 48 bits.
PART_BITS = 22


def names_of(part: int, number: np.ndarray) -> np.ndarray:
    """Names that no other part gives, above 0: ``number`` counts the part's keys in sorted order."""
    if part >= 1 << PART_BITS or (len(number) and int(number.max()) + 1 >= 1 << (47 - PART_BITS)):
        raise OverflowError("too many names; parts must be smaller")
    return (np.uint64(part) << np.uint64(47 - PART_BITS)) + number.astype(np.uint64) + np.uint64(1)


def name_shared(part: int, got: list[list[np.ndarray]], keys: int) -> list[np.ndarray]:
    """Names of what stands twice; 0 for what stands once.

    Each batch's columns are ``keys`` columns of its distinct keys and a flag, whether a key stands twice in the batch.
    """
    columns, cuts = joined(got)
    _, at, count = distinct(*columns[:keys])
    many = count > 1
    np.logical_or.at(many, at, columns[keys] > 0)
    name = np.where(many, names_of(part, np.arange(len(count))), np.uint64(0))
    return np.split(name[at], cuts)


def mark_shared(got: list[list[np.ndarray]], keys: int) -> list[np.ndarray]:
    """1 where a key comes from several batches or its flag says that it is repeated in one; 2 more in the first batch that holds it."""
    columns, cuts = joined(got)
    first, at, count = distinct(*columns[:keys])
    many = count > 1
    np.logical_or.at(many, at, columns[keys] > 0)
    bits = many[at].astype(np.uint8)
    bits[first] |= 2
    return np.split(bits, cuts)


def lowest(number: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The smallest value of each of ``n`` numbers."""
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, number, values)
    return low
