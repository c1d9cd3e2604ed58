"""Token-id shards with a minimal perfect hash index for keyed access.

Each shard is a range of document ids in ascending order: its ``.bin`` file holds raw little-endian
ids (16 bits where the vocabulary allows, else 32), its ``.idx`` file the document ids in order and a
minimal perfect hash over their keys with, per slot, a stored 64-bit fingerprint, the offset and the
length.  A shard has about ``SHARD_BYTES`` of text, so their number grows with the input.  Files are named
by task attempt and written once; ``manifest.json`` names those that count and the ids before each, so a
repeated task replaces nothing and no rename has to be atomic.

Cases: a null or empty text is one end id; rows with the same id stand next to each other, in the order of
their texts' first 64 characters, and are told apart by their number within a shard, which is part
of the key, so even an id with a third of all rows is spread over shards; a null id sorts first; an empty
table gives an empty manifest; columns besides the id and the text are not looked at; a very long text is
encoded whole.
"""

from __future__ import annotations

import io
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.exchange import input_bytes, texts_of
from tessera.llm.hashing import PerfectHash, mix
from tessera.llm.shared import durable, fresh_dir, narrow, open_store, parts_for, trim

#: Words in each generation of a worker's cache; two are kept, so frequent words outlive rare ones.
CACHE = 500_000
END_ID = 1
#: Bytes of text in a shard, about.
SHARD_BYTES = 64 << 20
#: Bytes of ids that a reader fetches at once.
READ_BYTES = 8 << 20


def splits_at_space(config: dict) -> bool:
    """Whether a tokenizer encodes the words between ASCII white space apart, whatever stands around them.

    So it is where the normaliser changes characters one by one or with those they combine with, and
    the first pre-tokenizer keeps only matches of a pattern that has no way to match white space.
    """
    steps = config.get("normalizer") or {"type": "Sequence", "normalizers": []}
    for step in steps.get("normalizers", [steps]):
        blank = step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "
        if step["type"] not in ("NFC", "Lowercase") and not blank:
            return False
    cut = config.get("pre_tokenizer") or {"type": ""}
    cut = cut["pretokenizers"][0] if cut["type"] == "Sequence" else cut
    if cut["type"] != "Split" or cut["behavior"] != "Removed" or not cut["invert"] or "Regex" not in cut["pattern"]:
        return False
    # each alternative: letters and apostrophes, or one class that is no white space
    return all(re.fullmatch(r"'[a-z]+|\[\\p\{[LN]\}\]\+?|\[\^\\s(\\p\{[LN]\})*\]\+?", x) for x in cut["pattern"]["Regex"].split("|"))


class WordEncoder:
    """Ids of whole texts; where the tokenizer splits at white space, from ids of words, each distinct word encoded once by the library."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = splits_at_space(json.load(f))
        self.dtype = "<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4"
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.limit = cache

    def whole(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.lib.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        split = [t.split() for t in texts]
        if len(self.words) >= self.limit:
            self.old, self.words = self.words, {}
        known, old = self.words, self.old
        new = []
        for w in {w for words in split for w in words if w not in known}:
            if w in old:
                known[w] = old[w]
            else:
                new.append(w)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            known.update(zip(some, self.whole(some), strict=True))
        return [b"".join([known[w] for w in words]) for words in split]


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def document_key(ids: np.ndarray, valid: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(ids.astype(np.uint64), 7) ^ mix(occurrence.astype(np.uint64), 11) ^ np.where(valid, np.uint64(0), np.uint64(0x5BD1E995))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return mix(keys, 977)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False), valid


def write_shards(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> None:
    """Encode all texts into shards of ``folder`` and write the manifest; what reaches the driver is one row per shard."""
    spark = docs.sparkSession

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = word_encoder(path), TaskContext.get()
        tail = b"" if end_id is None else np.array([end_id], dtype=enc.dtype).tobytes()
        width = np.dtype(enc.dtype).itemsize
        store, base = open_store(folder)
        name, out, all_ids, all_valid, sizes = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}", None, [], [], []
        for b in it:
            ids, valid = _ids(b.column("doc_id"))
            texts = texts_of(b.column("text"))
            if out is None and texts:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}.bin")
            for at in range(0, len(texts), 400):
                some = enc.encode(texts[at : at + 400])
                out.write(tail.join(some) + tail)
                sizes += [(len(x) + len(tail)) // width for x in some]
            all_ids.append(ids)
            all_valid.append(valid)
        trim()
        if out is None:
            return
        out.close()
        ids, valid, n = np.concatenate(all_ids), np.concatenate(all_valid), np.array(sizes, dtype=np.int64)
        at = np.cumsum(n) - n
        keys = document_key(ids, valid, _occurrence(ids, valid))
        index = PerfectHash(keys)
        slot = index.slot(keys)
        prints, offset, length = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        prints[slot], offset[slot], length[slot] = _fingerprint(keys), at * width, n
        raw = io.BytesIO()
        np.savez(raw, index=np.frombuffer(index.to_bytes(), dtype=np.uint8), prints=prints, offset=offset, length=length, width=width, ids=ids, valid=valid)
        with store.open_output_stream(f"{base}/{name}.idx") as f:
            f.write(raw.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["shard", "name", "n_docs", "n_ids"])

    parts = parts_for(spark, input_bytes(docs), SHARD_BYTES)
    rows = narrow(docs, id_col, text_col).withColumn("head", F.substr("text", F.lit(1), F.lit(64))).withColumn("hash", F.xxhash64("text")).withColumn("then", F.monotonically_increasing_id())
    order = ["doc_id", "head", "hash", "then"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = [r.asDict() for r in durable(dealt.mapInArrow(run, "shard int, name string, n_docs long, n_ids long")).orderBy("shard").collect()]
    start = 0
    for s in shards:
        s["start"], start = start, start + s["n_ids"]
    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(shards).encode())


def manifest(folder: str) -> list[dict]:
    """The shards in order: name, documents, ids, and the ids of all shards before."""
    store, base = open_store(folder)
    with store.open_input_file(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def _occurrence(ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The number of each row among the shard's rows of its id, which stand together."""
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])
    return np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))


class Shard:
    """Constant-time access to one shard's documents by key."""

    def __init__(self, folder: str, name: str):
        self.store, path = open_store(folder)
        with self.store.open_input_file(f"{path}/{name}.idx") as f:
            z = np.load(io.BytesIO(f.read()))
        self.index, self.prints, self.offset, self.length, self.width = PerfectHash.from_bytes(z["index"].tobytes()), z["prints"], z["offset"], z["length"], int(z["width"])
        self.doc_ids, self.valid = z["ids"], z["valid"]
        self.file = self.store.open_input_file(f"{path}/{name}.bin")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset and number of ids of each key; -1 where the stored fingerprint tells that it is absent."""
        slot = self.index.slot(keys)
        ok = (slot >= 0) & (self.prints[slot] == _fingerprint(keys)) if len(self.prints) else np.zeros(len(keys), bool)
        return np.where(ok, self.offset[slot], -1), np.where(ok, self.length[slot], -1)

    def ids(self, offset: int, length: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(int(length) * self.width, int(offset)), dtype=f"<u{self.width}")

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(document numbers, offsets, lengths, ids) of all documents in order, some megabytes at a time, found by key."""
        offset, length = self.find(document_key(self.doc_ids, self.valid, _occurrence(self.doc_ids, self.valid)))
        if (length < 0).any():
            raise ValueError("the index lacks documents of its shard")
        begin = 0
        while begin < len(offset):
            end = max(begin + 1, int(np.searchsorted(offset, offset[begin] + READ_BYTES)))
            got = self.ids(offset[begin], int(length[begin:end].sum()))
            at = (offset[begin:end] - offset[begin]) // self.width
            yield np.arange(begin, end), offset[begin:end], length[begin:end], [got[a : a + n] for a, n in zip(at.tolist(), length[begin:end].tolist(), strict=True)]
            begin = end


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, all read from the files; a task for each shard."""
    shards = manifest(folder)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, before in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard = Shard(folder, name)
                for rows, offset, length, ids in shard.documents():
                    sums = [zlib.crc32(x.astype("<u4")) for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[rows], pa.int64(), mask=~shard.valid[rows]), pa.array(before + offset // shard.width, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    rows = spark.createDataFrame([(s["name"], s["start"]) for s in shards], "name string, start long")
    return rows.repartition(max(1, len(shards)), "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(docs: DataFrame) -> str:
    return fresh_dir(docs.sparkSession, "token-shards")
