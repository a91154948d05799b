"""Quality classifier: random Fourier features over document statistics.

``document_statistics``  whole texts -> a vector of statistics (no vocabulary)
``fit``                  labelled rows -> ``Model``: the statistics are scaled,
                         mapped to random Fourier features (an approximate
                         Gaussian kernel), and ridge weights solve normal
                         equations that each partition sums for itself; scores
                         of other labelled rows, binned in each partition, are
                         calibrated by isotonic regression
``score``                a row a document, no shuffle

The fit may use a bounded sample: of more than ``sample`` labelled documents,
those with the smallest hashes of their ids (documented bound, parameter). All
documents are scored, over their whole texts.

Defined results: a null text scores as an empty one; several labels of one
document count as their largest; null labels and labels of unknown documents
are ignored; with no label, or one class only, every score is the share of
label 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbered, Words, blocks, pick, stored, string_array, text_bytes

#: Labelled documents that a fit takes at most (in expectation, by hash).
SAMPLE = 20_000
FEATURES = 384
GAMMA = 0.01
CLIP = 3.0
RIDGE = 1e-3
BINS = 1024
SEED = 17

NAMES = ("log_bytes", "log_words", "upper", "digit", "space", "newline", "symbol", "pipe", "stop_marks", "non_ascii", "word_length", "long_words", "same_next", "distinct_100", "top_word", "lone_symbols", "line_repeat", "log_lines", "symbol_ends", "caps_words")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_UPPER, _DIGIT, _SPACE = _class(bytes(range(65, 91))), _class(bytes(range(48, 58))), _class(b" \t\n\v\f\r")
_SYMBOL, _MARKS, _HIGH = _class(b"!#$%&*+<=>@\\^_`{}~"), _class(b".,;:?'\"()-"), _class(bytes(range(128, 256)))


def document_statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics a text, in the order of ``NAMES``."""
    data, at = text_bytes(texts)
    # shares lean towards 0 in short texts, which show little
    size = np.diff(at) + 30.0
    words = Words(texts)
    n = words.counts + 5.0
    share = lambda table: _sums(table[data], at) / size
    v, v_at = text_bytes(words.vocabulary)
    v_len = np.diff(v_at)
    v_marks = _sums(_SYMBOL[v] | _MARKS[v] | (v == 124), v_at)
    last = v[v_at[1:] - 1] if len(v) else np.zeros(0, np.uint8)
    lone, ends = v_marks == v_len, _SYMBOL[last]
    by_word = lambda x: _sums(x[words.codes], words.offsets) / n
    follows = np.zeros(len(words.codes), dtype=bool)
    follows[1:] = words.codes[1:] == words.codes[:-1]
    follows[np.minimum(words.offsets[:-1], max(len(follows) - 1, 0))[words.counts > 0]] = False
    # distinct words among windows of 100 words, and the most frequent word
    doc = np.repeat(np.arange(len(n)), words.counts)
    place = np.arange(len(words.codes)) - np.repeat(words.offsets[:-1], words.counts)
    key = (doc.astype(np.int64) << 40) | ((place // 100) << 24)
    order = np.lexsort((words.codes, key))
    k, c = key[order], words.codes[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    distinct = np.bincount(doc[order][new], minlength=len(n)) / n
    runs = np.flatnonzero(new)
    top = np.zeros(len(n))
    np.maximum.at(top, doc[order][runs], np.diff(np.append(runs, len(k))))
    # lines: the raw bytes cut at line feeds
    cut = data == 10
    line_at = np.unique(np.concatenate([at, np.flatnonzero(cut) + 1]))
    lines = string_array(data, line_at.astype(np.int64)).dictionary_encode().indices.to_numpy() if len(line_at) > 1 else np.zeros(0, np.int64)
    line_doc = np.searchsorted(at, line_at[:-1], side="right") - 1
    n_lines = np.maximum(np.bincount(line_doc, minlength=len(n)), 1)
    pairs = np.unique(line_doc.astype(np.int64) << 32 | lines.astype(np.int64))
    line_repeat = 1 - np.maximum(np.bincount(pairs >> 32, minlength=len(n)), 1) / n_lines
    # words in capitals: their upper-case letters, from the bytes
    caps = _sums(_UPPER[data[1:]] & _UPPER[data[:-1]] if len(data) else np.zeros(0, bool), np.maximum(np.minimum(at, max(len(data) - 1, 0)), 0)) / size
    return np.stack(
        [np.log1p(np.diff(at)), np.log1p(words.counts), share(_UPPER), share(_DIGIT), share(_SPACE), share(data_class(10)), share(_SYMBOL), share(data_class(124)), share(_MARKS), share(_HIGH),
         by_word(v_len), by_word(v_len > 14), _sums(follows, words.offsets) / n, distinct, top / np.minimum(n, 105), by_word(lone), line_repeat, np.log1p(n_lines), by_word(ends), caps],
        axis=1,
    ).astype(np.float64)


def data_class(byte: int) -> np.ndarray:
    return _class(bytes([byte]))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return fourier(self.scaled(statistics)) @ self.weights

    def scaled(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.scale, -CLIP, CLIP)

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(statistics), self.knots, self.values), 0.0, 1.0)


@functools.cache
def _projection(width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(scale=np.sqrt(2 * GAMMA), size=(width, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(scaled: np.ndarray) -> np.ndarray:
    """Random features whose products approximate a Gaussian kernel, and a 1."""
    w, b = _projection(scaled.shape[1])
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(scaled @ w + b), np.ones((len(scaled), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x: knots (centres of pools) and
    their values."""
    pools: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def statistics_of(rows: DataFrame, keep: str) -> DataFrame:
    """``rows`` (text and the columns of the DDL ``keep``) with ``stats``."""
    names = [x.split()[0] for x in keep.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            stats = document_statistics(block.column("text"))
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * stats.shape[1]), pa.array(stats.ravel()))], names=[*names, "stats"])

    return rows.select(*names, "text").mapInArrow(made, keep + ", stats array<double>")


def _partition_sums(rows: DataFrame, build) -> list[np.ndarray]:
    """Sum over all partitions of a tuple of arrays that ``build(stats, y)``
    makes; each partition sends one sum."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                stats = np.array(batch.column("stats").flatten()).reshape(batch.num_rows, -1)
                got = build(stats, batch.column("y").to_numpy().astype(np.float64))
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([i for i in range(len(total))]), pa.array([x.astype(np.float64).tobytes() for x in total], pa.binary())], names=["i", "sums"])

    out: dict[int, np.ndarray] = {}
    for row in rows.select("stats", "y").mapInArrow(made, "i long, sums binary").collect():  # a few rows a partition of a bounded sample
        x = np.frombuffer(row.sums)
        out[row.i] = out[row.i] + x if row.i in out else x
    return [out[i] for i in sorted(out)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents (labels: doc_id and ``quality`` 0 or 1)."""
    width = len(NAMES)
    flat = lambda p: Model(np.zeros(width), np.ones(width), np.zeros(FEATURES + 1), np.zeros(1), np.array([p]))
    known = pick(labels, doc_id="long", quality="int").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y"))
    total = known.count()
    if not total:
        return flat(0.5)
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    taken = known.where(part < int((1 << 30) * min(1.0, sample / total))) if total > sample else known
    # at most about ``sample`` rows of twelve bytes: a bounded broadcast
    rows = pick(docs, doc_id="long", text="string").join(F.broadcast(taken), "doc_id")
    rows = stored(statistics_of(rows.withColumn("fold", (F.pmod(F.xxhash64("doc_id"), F.lit(3))).cast("int")), "doc_id long, y int, fold int"), "quality").coalesce(16)

    moments = _partition_sums(rows, lambda s, y: [s.sum(axis=0), (s * s).sum(axis=0), np.array([len(s), y.sum()])])
    if not moments:
        return flat(0.5)
    n, ones = moments[2]
    if ones in (0, n):
        return flat(float(ones / n))
    mean = moments[0] / n
    model = Model(mean, np.sqrt(np.maximum(moments[1] / n - mean**2, 0)) + 1e-3, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def normal(s: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = fourier(model.scaled(s))
        return [(z.T @ z).ravel(), z.T @ y, np.array([len(z)])]

    gram, moment, m = _partition_sums(rows.where("fold <> 0"), normal) or _partition_sums(rows, normal)
    gram = gram.reshape(FEATURES + 1, -1)
    model.weights = np.linalg.solve(gram + RIDGE * m[0] / 100 * np.eye(len(gram)), moment)

    def histogram(s: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        at = np.clip(((model.raw(s) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return [np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]

    count, good = _partition_sums(rows.where("fold = 0"), histogram) or _partition_sums(rows, histogram)
    full = np.flatnonzero(count)
    # one further row of either class at the ends keeps scores from 0 and 1
    x, y, w = (full + 0.5) / BINS * 2 - 0.5, good[full] / count[full], count[full]
    model.knots, model.values = isotonic(np.concatenate([[x[0]], x, [x[-1]]]), np.concatenate([[0.0], y, [1.0]]), np.concatenate([[0.5], w, [0.5]]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            s = shared.value.score(document_statistics(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return pick(docs, doc_id="long", text="string").mapInArrow(made, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model accepts, with all their columns: each row
    is judged where it stands, without a join, and only its text goes to
    Python. Rows of a table without texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        parts = [np.zeros(0, bool)]
        for block in blocks([pa.RecordBatch.from_arrays([texts], names=["text"])]):
            parts.append(shared.value.score(document_statistics(block.column("text"))) >= 0.5)
        return pa.array(np.concatenate(parts))

    own = Numbered(docs)
    return own.restored(own.rows.where(good(own.column("text", "string"))))

