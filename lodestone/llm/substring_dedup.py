"""Substring dedup against a log-structured index of window hashes (operator 2)."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import arrays as A
from lodestone.llm import chunks as C
from lodestone.llm import repeats as R
from lodestone.llm.arrays import U64

_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
RUN_SCHEMA = "bucket int, blob binary"


@dataclass
class Run:
    """An immutable sorted run, a table of the index: for each bucket the (window hash, stretch, chunk) of its batches, sorted by hash."""

    name: str
    batches: int


def merge_sorted(blobs: list) -> bytes:
    """The entries of sorted runs as one sorted run; of equal (hash, stretch) one stays."""
    (h, s, c), _ = A.concat(blobs, 3)
    o = np.lexsort((c, s, h))
    h, s, c = h[o], s[o], c[o]
    first = A.starts_of_groups(h, s)
    return A.pack(h[first], s[first], c[first])


class FingerprintIndex:
    """Incremental removal of repeated word windows, with a log-structured index.

    Every batch adds one immutable run of its window hashes, sorted by hash within hash buckets. (A window is kept
    under the hash of its minimiser with a second hash of all words around it; see repeats.py. That is one entry for
    about nine windows, and loses none.) A new batch is merge-joined with the runs bucket by bucket; a hit is
    verified by the second hash, and where equal minimisers stand in different surroundings, window by window on the
    texts of both sides. When ``fan_in`` runs have the same number of batches, they are compacted to one.

    Runs and texts are Parquet tables below ``path``, which all executors share (unset: a new folder in
    spark.checkpoint.dir, or below the warehouse). A table of its own, written last, lists those that count, so a
    batch that failed leaves the index as it was; open() goes on with an index, in another session too. ``add`` must
    get its batches in the order in which the earlier text is to stay.
    """

    def __init__(self, spark: SparkSession, window: int = 20, k: int = 4, fan_in: int = 4, buckets: int | None = None, path: str | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.spec = R.Windows("words", window, min(k, window), True)
        self.n = buckets or C.partitions(spark)
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.path = path or f"{shared.rstrip('/')}/fingerprint-index-{uuid.uuid4().hex}"
        self.runs: list[Run] = []
        self.texts: list[str] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that add() left at ``path``."""
        versions = [int(f.getPath().getName().split("-")[1]) for f in cls._files(spark, path).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)) if f.getPath().getName().startswith("list-")]
        complete = [v for v in sorted(versions) if cls._files(spark, path).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/list-{v}/_SUCCESS"))]
        if not complete:
            raise FileNotFoundError(f"no index at {path}")
        rows = spark.read.parquet(f"{path}/list-{complete[-1]}").orderBy("nth").collect()
        about = next(r for r in rows if r["kind"] == "index")
        index = cls(spark, about["window"], about["k"], about["fan_in"], about["buckets"], path)
        index.runs = [Run(r["name"], r["batches"]) for r in rows if r["kind"] == "run"]
        index.texts = [r["name"] for r in rows if r["kind"] == "text"]
        index.version = complete[-1]
        return index

    @staticmethod
    def _files(spark: SparkSession, path: str):
        return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _drop(self, name: str) -> None:
        self._files(self.spark, self.path).delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def drop(self) -> None:
        """Removes the index's tables."""
        self._files(self.spark, self.path).delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        C.cleaned(rows).write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{n}" for n in names))

    def _list(self) -> None:
        """Writes down what belongs to the index."""
        s = self.spec
        rows = [("index", "", 0, s.window, s.k, self.fan_in, self.n)] + [("run", r.name, r.batches, 0, 0, 0, 0) for r in self.runs] + [("text", t, 0, 0, 0, 0, 0) for t in self.texts]
        ddl = "nth int, kind string, name string, batches int, window int, k int, fan_in int, buckets int"
        self.version += 1
        self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ddl).coalesce(1).write.parquet(f"{self.path}/list-{self.version}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True, last: bool = False) -> DataFrame:
        """Removes from docs each word covered by a window that starts earlier: in a batch added before, in a smaller id, or earlier in the same document.

        Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space) and, with
        ``with_kept``, kept. A null text has no words; a null id comes after all others of its batch, and rows with
        equal ids count as one document. last: no batch follows, so no run is written.
        """
        spec, n = self.spec, self.n
        chunks = C.make_chunks(docs, id_col, text_col)
        number = len(self.texts)
        if number:  # chunk numbers are unique over all batches
            chunks = chunks.withColumn("chunk", F.col("chunk") + F.lit(number << 52))
        asked = R.asked_stretches(chunks, spec, n)
        if not last:
            asked = C.checkpoint(asked)
        answers = C.checkpoint(self._merge_join(asked))
        both = C.with_answers(chunks, answers, "stretches").withColumn("old", F.lit(False))
        everything = both
        if self.texts:
            before = C.with_answers(self._read(self.texts), answers, "stretches", "inner").withColumn("old", F.lit(True))
            everything = both.unionByName(before)
        windows = C.answer(R.asked_windows(everything, spec, n, "stretches", "old"), R.settle_windows)
        out = self._finish(C.with_answers(both, C.checkpoint(windows), "windows"), with_kept)
        if not last:
            self._commit(asked, chunks)
        return out

    def _merge_join(self, asked: DataFrame) -> DataFrame:
        """(chunk, blob): what the runs and the batch itself have of each chunk's windows; for chunks of earlier batches which of theirs are in question."""
        if not self.runs:
            return C.answer(asked, lambda i, b: R.settle_stretches(i, b)[0])

        def merge(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            if not len(new):
                return pd.DataFrame({"chunk": pd.Series([], dtype="int64"), "blob": []})
            h, s, c = A.unpack(merge_sorted(old["blob"].tolist())) if len(old) else (R.NOTHING,) * 3
            out, asked_of_old = R.settle_stretches(new["chunk"].tolist(), new["blob"].tolist(), (h, s))
            rows = [(int(i), b) for i, b in zip(new["chunk"], out) if b is not None]
            at = np.flatnonzero(R.member(h, asked_of_old))
            for i in np.unique(c[at]).tolist():
                own = np.unique(h[at[c[at] == i]])
                zero = np.zeros(len(own), U64)
                rows.append((i, A.pack(own, ~zero, zero, zero, zero + U64(1))))  # no stretch has that hash
            return pd.DataFrame({"chunk": np.array([r[0] for r in rows], dtype="int64"), "blob": [r[1] for r in rows]})

        old = self._read([r.name for r in self.runs])
        return asked.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInPandas(merge, C.ANSWER_SCHEMA)

    def _commit(self, asked: DataFrame, chunks: DataFrame) -> None:
        def sort(pdf: pd.DataFrame) -> pd.DataFrame:
            blobs = []
            for chunk, b in zip(pdf["chunk"], pdf["blob"]):
                h, s = A.unpack(b)[:2]
                blobs.append(A.pack(h, s, np.full(len(h), chunk, dtype=U64)))
            return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "blob": [merge_sorted(blobs)]})

        self.runs.append(Run(self._write(asked.groupBy("bucket").applyInPandas(sort, RUN_SCHEMA), "run"), 1))
        self.texts.append(self._write(chunks, "text"))
        self._list()
        self.compact()

    def compact(self) -> None:
        """Merges the newest ``fan_in`` runs of equal size into one, again while there are such."""
        while len(self.runs) >= self.fan_in and len({r.batches for r in self.runs[-self.fan_in :]}) == 1:
            tail = self.runs[-self.fan_in :]

            def merge(pdf: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "blob": [merge_sorted(pdf["blob"].tolist())]})

            merged = self._write(self._read([r.name for r in tail]).groupBy("bucket").applyInPandas(merge, RUN_SCHEMA), "run")
            self.runs[-self.fan_in :] = [Run(merged, sum(r.batches for r in tail))]
            self._list()
            for r in tail:
                self._drop(r.name)

    def _finish(self, chunks: DataFrame, with_kept: bool) -> DataFrame:
        spec = self.spec
        fields = _FIELDS if with_kept else _FIELDS[:-1]

        def make(row):
            c, covers = R.covered(row, spec, "stretches", "windows")
            cols = [c.ids, [], [], [], []]
            for text, cover, n in zip(c.texts, covers, c.counts.tolist()):
                words = (text or b"").split()
                if cover is not None:
                    words = [w for w, gone in zip(words, cover.tolist()) if not gone]
                kept = b" ".join(words)
                for col, v in zip(cols[1:], (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept)):
                    col.append(v)
            return cols[: len(fields)]

        ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_kept
        return R.finish(chunks, pa.schema(fields), ddl, make)


def substring_dedup(docs: DataFrame, window: int = 20, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True, fan_in: int = 2) -> DataFrame:
    """All of docs through a new index, in ``batches`` batches of ascending ids, of which ``fan_in`` are compacted to one run; the
    result is the same for any number of batches. The index is dropped at the end, as nothing follows."""
    index = FingerprintIndex(docs.sparkSession, window, fan_in=fan_in)
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)] or [1.0], 1000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or [])) if batches > 1 else []
    out, low = None, None
    for cut in [*cuts, None]:
        i = F.col(id_col).cast("long")
        part = F.lit(True) if low is None else i > low
        part = part & (i <= cut) if cut is not None else part | i.isNull()
        got = index.add(docs.where(part), id_col, text_col, with_kept, last=cut is None)
        out, low = got if out is None else out.unionByName(got), cut
    index.drop()
    return out


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, windows of 20 words."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS w
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d WHERE len(ws) >= 20)),
m AS (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1 AS again FROM g),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM m, range(0, 20) AS r(o) WHERE again),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {"op2_substring_dedup": ORACLE_SQL}
