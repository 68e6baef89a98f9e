"""Suffix-array dedup: removal of byte strings that an earlier document has (operator 5)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.llm import chunks as C
from lodestone.llm import repeats as R

_FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]


def _ordered(docs: DataFrame, threshold: int, id_col: str, text_col: str, rest: list[str] | None) -> tuple[R.Windows, DataFrame]:
    """The chunks of docs with what the passes found about them."""
    spark = docs.sparkSession
    n = C.partitions(spark)
    spec = R.Windows("bytes", threshold, min(24, threshold), False)
    chunks = C.make_chunks(docs, id_col, text_col, rest=rest)
    first = C.with_answers(chunks, R.shared(chunks, spec, n), "among")
    second = C.checkpoint(C.answer(R.asked_stretches(first, spec, n, "among"), lambda i, b: R.settle_stretches(i, b)[0]))
    both = C.with_answers(chunks, second, "stretches")
    third = C.answer(R.asked_windows(both, spec, n, "stretches"), R.settle_windows)
    both = C.with_answers(both, third, "windows")
    return spec, both


def suffix_dedup(docs: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """Cuts every byte covered by a string of ``threshold`` bytes that also starts in a document with a smaller id.

    A depth-limited radix sort of the suffixes, most significant digit first: digit by digit (a 24-byte k-gram at
    the suffix's minimiser, the stretch around it, the whole ``threshold`` bytes), and only groups of equal suffixes
    from two or more documents go on to the next digit (see repeats.py). Equal groups after the last digit are
    exactly the repeated windows; no suffix is ordered beyond ``threshold`` bytes.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with ``with_kept``, kept
    (the remaining bytes; a cut may fall inside a character). A null text counts as empty. A null id comes after all
    others, and rows with equal ids take nothing from each other. Other columns of docs are not looked at.
    """
    spec, both = _ordered(docs, threshold, id_col, text_col, None)
    fields = _FIELDS if with_kept else _FIELDS[:-1]

    def make(row):
        c, covers = R.covered(row, spec, "stretches", "windows")
        cols = [c.ids, [], [], [], [], []]
        for text, cover in zip(c.texts, covers):
            text = text or b""
            kept, spans = text, 0
            if cover is not None:
                kept = np.frombuffer(text, np.uint8)[~cover].tobytes()
                spans = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
            for col, v in zip(cols[1:], (len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)):
                col.append(v)
        return cols[: len(fields)]

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return R.finish(both, pa.schema(fields), ddl, make)


def with_repeats_cut(docs: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, row for row and with the same columns, the texts without what suffix_dedup() cuts. What is left of a
    character that a cut divides goes too. Null texts stay null; a column n_chars beside the text is set anew."""
    rest = [c for c in docs.columns if c != text_col]
    spec, both = _ordered(docs, threshold, id_col, text_col, rest)
    schema = to_arrow_schema(docs.select(F.struct(*map(F.col, rest)).alias("rest"), F.col(text_col).cast("string").alias("text")).schema)

    def make(row):
        c, covers = R.covered(row, spec, "stretches", "windows")
        texts = []
        for text, cover in zip(c.texts, covers):
            if cover is not None:
                text = np.frombuffer(text, np.uint8)[~cover].tobytes()
            texts.append(None if text is None else text.decode("utf-8", "ignore"))
        return [C.load_rest(row["docs"]).cast(schema.field("rest").type), texts]

    ddl = T.StructType([T.StructField("rest", T.StructType([docs.schema[c] for c in rest])), T.StructField("text", T.StringType())])
    out = R.finish(both, schema, ddl, make)
    number = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in rest else None
    columns = {text_col: F.col("text")} | ({"n_chars": number} if "n_chars" in rest else {})
    return out.select(*(columns.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, strings of 50 bytes."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False)


#: Byte k of the text is characters 2k+1 and 2k+2 of its hex form.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, s, substr(x, 2 * s + 1, 100) AS w
      FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS s FROM d WHERE length(x) >= 100)),
m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY w) < doc_id AS again FROM g),
c AS (SELECT doc_id, s, again, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM m WHERE again),
r AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM c),
runs AS (SELECT doc_id, run, min(s) AS a, max(s) + 50 AS b FROM r GROUP BY doc_id, run),
parts AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from FROM runs),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail, list(struct_pack(f := kept_from, t := a) ORDER BY a) AS l FROM parts GROUP BY doc_id),
k AS (SELECT d.doc_id, d.x, cut.n_spans, cut.n_removed,
      CASE WHEN cut.doc_id IS NULL THEN d.x
           ELSE array_to_string(list_transform(cut.l, lambda p: substr(d.x, 2 * p.f + 1, 2 * (p.t - p.f))), '') || substr(d.x, 2 * cut.tail + 1) END AS kept
      FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM k
"""
QUERIES = {"op5_suffix_array_dedup": op5_suffix_array_dedup}
ORACLES = {"op5_suffix_array_dedup": ORACLE_SQL}
