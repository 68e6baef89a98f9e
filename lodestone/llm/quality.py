"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import arrays as A
from lodestone.llm.arrays import U64
from lodestone.llm.labelled import buffers, held_out, logistic, sample

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 6000
#: Hash buckets of words.
WORDS = 1 << 12
RANK = 4

_CLASSES = ["lower", "upper", "digit", "space", "line", "high", "stop", "shout", "sign", "bar", "other"]
_CLASS = np.full(256, _CLASSES.index("other"), dtype=np.int64)
for _name, _bytes in {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n",
    "high": bytes(range(128, 256)), "stop": b".,;:", "shout": b"!?", "sign": b"#$%&*@+=^~_<>\\/", "bar": b"|-",
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)
#: Shares of byte classes, then statistics of words and lines, then metadata.
STATS = [*_CLASSES, "log bytes", "log words", "word length", "distinct words", "distinct pairs", "same as last", "most common", "words a line", "n_chars", "n_chars missing"]


def features(texts: list[bytes], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its hashed words as (document, bucket, value) with values whose squares sum to 1, and its statistics."""
    m = len(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    doc_of = np.repeat(np.arange(m), sizes + 1)[: len(buf)]
    classes = np.bincount(doc_of * len(_CLASSES) + _CLASS[buf], minlength=m * len(_CLASSES)).reshape(m, -1).astype(float)
    classes[:-1, _CLASSES.index("line")] -= 1  # the separators
    lower = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    starts, stops = A.word_spans(lower)
    h = A.word_hashes(lower, starts, stops)
    doc = np.searchsorted(ends, starts, side="left")
    n = np.bincount(doc, minlength=m).astype(float)
    one = np.maximum(n, 1)

    def distinct(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        o = np.lexsort((keys, of))
        first = A.starts_of_groups(of[o], keys[o])
        return of[o][first], keys[o][first], np.diff(np.concatenate((first, [len(o)])))

    d, bucket, count = distinct((h >> U64(20)) % U64(WORDS), doc)
    value = np.sqrt(count / one[d])
    wd, _, wc = distinct(h, doc)
    most = np.zeros(m)
    np.maximum.at(most, wd, wc)
    inner = doc[1:] == doc[:-1]
    pd_, _, _ = distinct((A.mix(h[:-1]) + h[1:])[inner], doc[1:][inner])
    again = np.bincount(doc[1:][inner & (h[1:] == h[:-1])], minlength=m)
    lines = classes[:, _CLASSES.index("line")] + 1
    stats = np.column_stack([
        classes / np.maximum(sizes, 1)[:, None], np.log1p(sizes), np.log1p(n), np.bincount(doc, stops - starts, minlength=m) / one,
        np.bincount(wd, minlength=m) / one, np.bincount(pd_, minlength=m) / np.maximum(n - 1, 1), again / one, most / one, np.log1p(n / lines),
        np.log1p(np.nan_to_num(np.maximum(n_chars, 0))), np.isnan(n_chars),
    ])
    return d, bucket.astype(np.int64), value, stats


@dataclass
class FactorisationMachine:
    """w0 + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j, the pairs by the identity
    ((sum v_i x_i)^2 - sum (v_i x_i)^2) / 2, in time linear in the features that are not 0."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, d, j, x, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features as (document, feature, value): statistics in standard units, held within 4, after the words."""
        m, k = stats.shape
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(k)
        return np.concatenate((d, np.repeat(np.arange(m), k))), np.concatenate((j, np.tile(WORDS + np.arange(k), m))), np.concatenate((x, z.ravel()))

    def raw(self, d, j, x, m: int) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[j] * x[:, None]
        s = np.column_stack([np.bincount(d, vx[:, f], minlength=m) for f in range(self.v.shape[1])])
        pairs = (s**2).sum(axis=1) - np.bincount(d, (vx**2).sum(axis=1), minlength=m)
        return self.bias + np.bincount(d, self.w[j] * x, minlength=m) + pairs / 2, s

    def score(self, texts: list[bytes], n_chars: np.ndarray) -> np.ndarray:
        d, j, x, stats = features(texts, n_chars)
        return logistic(self.raw(*self.rows(d, j, x, stats), len(texts))[0])


def fit(d, j, x, stats, y, epochs: int = 15, batch: int = 128, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """Log loss by Adam over batches of documents. d ascends."""
    size, rng = WORDS + stats.shape[1], np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (len(y) + 1)
    fm = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)), stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6))
    if len(set(y.tolist())) < 2:
        fm.v[:] = 0
        return fm
    d, j, x = fm.rows(d, j, x, stats)
    o = np.argsort(d, kind="stable")
    d, j, x = d[o], j[o], x[o]
    at = np.searchsorted(d, np.arange(len(y) + 1))
    params = np.column_stack((fm.w, fm.v))
    m1, m2, step = np.zeros_like(params), np.zeros_like(params), 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for docs in np.split(order, range(batch, len(y), batch)):
            places, own = A.spread(at[docs], at[docs + 1] - at[docs])
            jj, xx = j[places], x[places]
            fm.w, fm.v = params[:, 0], params[:, 1:]
            raw, s = fm.raw(own, jj, xx, len(docs))
            g = (logistic(raw) - y[docs]) / len(docs)
            gx = g[own] * xx
            grad = np.column_stack([np.bincount(jj, gx, minlength=size)] + [np.bincount(jj, gx * (s[own, f] - fm.v[jj, f] * xx), minlength=size) for f in range(RANK)])
            grad += decay * params
            step += 1
            m1 = 0.9 * m1 + 0.1 * grad
            m2 = 0.999 * m2 + 0.001 * grad**2
            params -= rate * (1 - epoch / epochs) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            fm.bias -= rate * (1 - epoch / epochs) * g.sum()
    fm.w, fm.v = np.ascontiguousarray(params[:, 0]), np.ascontiguousarray(params[:, 1:])
    return fm


_FEATURES_DDL = "y int, bucket array<int>, value array<float>, stats array<double>"


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fits on at most ``most`` labelled documents (labelled.sample); the features are made on the executors.

    Without labels, or with one kind only, the model gives every text about that share."""
    rows = sample(docs, labels, label, most, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in buffers(batches, 1):
            n = np.array([np.nan if t is None else float(len(t)) for t in b.column(1).to_pylist()])
            d, j, x, stats = features(texts, n)
            at = np.searchsorted(d, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([
                b.column(2).cast(pa.int32()), pa.array([j[a:e].astype(np.int32) for a, e in zip(at, at[1:])], pa.list_(pa.int32())),
                pa.array([x[a:e].astype(np.float32) for a, e in zip(at, at[1:])], pa.list_(pa.float32())), pa.array(list(stats), pa.list_(pa.float64())),
            ], names=["y", "bucket", "value", "stats"])

    got: pd.DataFrame = rows.select("id", "text", "y").mapInArrow(run, _FEATURES_DDL).toPandas()
    got = got.iloc[np.argsort([float(np.sum(s)) for s in got["stats"]], kind="stable")]  # in an order of their own
    d = np.repeat(np.arange(len(got)), [len(b) for b in got["bucket"]])
    cat = lambda c, kind: np.concatenate([np.zeros(0, kind), *got[c]]).astype(kind)
    stats = np.array(got["stats"].tolist(), dtype=float).reshape(-1, len(STATS))
    if not len(got):
        stats = np.zeros((1, len(STATS)))
        return fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0), stats, np.array([0.5]))
    return fit(d, cat("bucket", np.int64), cat("value", float), stats, got["y"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs: the chance that its text is of quality 1.

    A null text counts as empty; both get a score like any other. The metadata is the text's length in characters
    (missing for null). Repeated rows stay, null ids are held out, and other columns of docs are not looked at.
    """
    model = train(docs, labels, "quality", SAMPLE, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in buffers(batches, 1):
            n = b.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(texts, n))], schema=schema)

    text = F.col(text_col).cast("string")
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.length(text).alias("n")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, learning from labels.quality."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
