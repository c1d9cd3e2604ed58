"""Quality rules and gradient-boosted trees over document statistics.

The trees are fitted here, on a bounded sample of labelled rows, by second-order boosting over
feature histograms; features that only ever speak against a document get a monotonic constraint.  A
fitted model is a handful of numpy node arrays, and scoring walks all rows down one level at a time.

Cases: a null or empty text has no words and fails the base rules; without labels, or with one class
only, the trees judge nothing and the base rules stand alone; rows with the same id or none are judged one
by one, and equal rows alike; an empty table gives none; other columns are not looked at, and ``keep``
keeps them as they are; a very long text is measured whole, with some 100 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.llm.exchange import grouped, texts_of
from tessera.llm.hashing import Joined, Slices, mix
from tessera.llm.shared import narrow, size_batches, trim

#: Labelled rows that a model is fitted on at most: those whose id hashes lowest.
SAMPLE = 4000
SLICE_BYTES = 1 << 20
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "line_length", "distinct_share", "top_word_share", "long_word_share", "high_byte_share"]
#: -1: a larger value never raises the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "top_word_share": -1}

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[list(range(0x41, 0x5B))] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[list(range(0x30, 0x3A))] = 1
_MARK = np.zeros(256, dtype=np.int64)
_MARK[list(b".,;:!?")] = 1
_START = np.array([int(b & 0xC0 != 0x80) for b in range(256)])
_HIGH = np.array([int(b >= 0x80) for b in range(256)])


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[end] - total[begin]


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (documents × 5, integers) and the features (documents × 13)."""
    j = Joined(texts)
    n_docs, n = len(texts), j.n_words
    per_byte = lambda table: _sums(table[j.data], j.begin, j.end)
    inside = np.ones(256, dtype=np.int64)
    inside[[0x20, *range(0x09, 0x0E)]] = 0
    chars = per_byte(_START * inside)
    symbols = per_byte(_SYMBOL)
    doc = j.doc_of_word()
    words = j.word_hashes()
    # words in 5-word windows that occur twice or more in their document
    w = np.arange(len(words))
    w = w[w + 5 <= np.repeat(j.first[1:], n)] if len(words) else w
    repeat = np.zeros(n_docs, dtype=np.int64)
    if len(w):
        key = mix(Slices(words).hash(w, w + 5) ^ mix(doc[w].astype(np.uint64), 3))
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = w[count[at] > 1]
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + 5, -1)
        repeat = _sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), j.first[:-1], j.first[1:])
    dup, lines = np.zeros(n_docs, dtype=np.int64), np.zeros(n_docs, dtype=np.int64)
    for d, text in enumerate(texts):
        some = [x for x in text.split(b"\n") if x.strip()]
        lines[d], dup[d] = len(some), len(some) - len(set(some))
    distinct, top = np.zeros(n_docs), np.zeros(n_docs)
    if len(words):
        _, first, count = np.unique(mix(words ^ mix(doc.astype(np.uint64), 5)), return_index=True, return_counts=True)
        np.add.at(distinct, doc[first], 1)
        np.maximum.at(top, doc[first], count)
    long_words = _sums((j.word_end - j.word_start > 14).astype(np.int64), j.first[:-1], j.first[1:])
    base = np.stack([n, chars, symbols, dup, repeat], axis=1).astype(np.int64)
    some, chars1 = np.maximum(n, 1), np.maximum(chars, 1)
    features = np.stack(
        [np.log1p(n), chars / some, symbols / chars1, dup / np.maximum(lines, 1), repeat / some, per_byte(_UPPER) / chars1, per_byte(_DIGIT) / chars1, per_byte(_MARK) / some, n / np.maximum(lines, 1), distinct / some, top / some, long_words / some, per_byte(_HIGH) / chars1],
        axis=1,
    )
    return base, features


@dataclass
class Trees:
    """Complete trees of one depth: node arrays (trees × inner nodes) and leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    cut: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        n_trees, inner = self.feature.shape
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(n_trees):
            node = np.zeros(len(x), dtype=np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.leaf[t, node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, monotone: list[int] | None = None) -> Trees:
    """Boost complete trees on logistic loss; both halves of a constrained split are bounded by their middle."""
    n, d = x.shape
    monotone = monotone or [0] * d
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(d)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, 2**depth))
    total = np.full(n, start)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            lo, hi = low[k], high[k]
            low[[2 * k + 1, 2 * k + 2]], high[[2 * k + 1, 2 * k + 2]] = lo, hi
            best = (1e-6, None)
            if len(at) >= 10:
                for f in range(d):
                    m = len(edges[f])
                    if not m:
                        continue
                    gs, hs = np.bincount(binned[at, f], g[at], m + 1).cumsum(), np.bincount(binned[at, f], h[at], m + 1).cumsum()
                    gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                    left, right = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
                    gain = -(gl * left + 0.5 * (hl + ridge) * left**2) - (gr * right + 0.5 * (hr + ridge) * right**2) - 0.5 * gs[-1] ** 2 / (hs[-1] + ridge)
                    gain[(hl < 1e-3) | (hr < 1e-3)] = -np.inf
                    if monotone[f]:
                        gain[(right - left) * monotone[f] < 0] = -np.inf
                    b = int(np.argmax(gain))
                    if gain[b] > best[0]:
                        best = (gain[b], (f, b, left[b], right[b]))
            if best[1] is None:
                node[at] = 2 * k + 1  # an infinite threshold sends every row left
                continue
            f, b, left, right = best[1]
            feature[t, k], threshold[t, k] = f, edges[f][b]
            node[at] = 2 * k + 1 + (binned[at, f] > b)
            if monotone[f]:
                middle = (left + right) / 2
                (high if monotone[f] > 0 else low)[2 * k + 1] = middle
                (low if monotone[f] > 0 else high)[2 * k + 2] = middle
        for k in range(2**depth):
            at = np.flatnonzero(node == inner + k)
            if len(at):
                leaf[t, k] = rate * np.clip(-g[at].sum() / (h[at].sum() + ridge), low[inner + k], high[inner + k])
            else:
                leaf[t, k] = rate * np.clip(0, low[inner + k], high[inner + k])
        total += leaf[t, node - inner]
    return Trees(feature, threshold, leaf, start)


def _measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in grouped(it, SLICE_BYTES):
        _, x = statistics(texts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "x"])


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Trees | None:
    """A model from at most ``sample`` labelled documents; only those rows' features reach the driver."""
    chosen = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("y")).where("doc_id is not null and y is not null")
    chosen = chosen.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = narrow(docs, id_col, text_col)
    some = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").mapInArrow(_measure, "doc_id long, x array<double>")
    got = some.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "x").limit(2 * sample).toPandas()
    if got.empty or got["y"].nunique() < 2:
        return None
    return fit(np.array(got["x"].tolist()), got["y"].to_numpy() > 0.5, monotone=[MONOTONE.get(f, 0) for f in FEATURES])


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judged(texts: list[bytes], trees: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, whether the base rules fail, the trees' score, and what stays."""
    base, x = statistics(texts)
    failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
    score = np.ones(len(texts)) if trees is None else trees.score(x)
    return base, failed, score, ~failed & (score >= (0.5 if trees is None else trees.cut))


def judge(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base counts, the base verdict, the trees' score and the verdict; one scan, no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in grouped(it, SLICE_BYTES):
            base, failed, score, kept = judged(texts, trees)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(base[:, i], pa.int64()) for i in range(5)), pa.array(failed), pa.array(score), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "score", "kept"])

    return narrow(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; one scan, no shuffle."""

    names, at = docs.columns, docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts, verdicts, some, size = texts_of(b.column(at)), [], [], 0
            for t in texts:
                if some and size + len(t) > SLICE_BYTES:
                    verdicts.append(judged(some, trees)[3])
                    some, size = [], 0
                some.append(t)
                size += len(t) + 16
            if some:
                verdicts.append(judged(some, trees)[3])
            if verdicts:
                yield b.filter(pa.array(np.concatenate(verdicts)))
        trim()

    size_batches(docs.sparkSession)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names with dots are no names for a plan's columns
    return plain.mapInArrow(run, StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema)])).toDF(*names)
