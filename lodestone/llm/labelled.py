"""What the classifiers share: folds, a bounded sample of labelled documents, batches of texts as one buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are looked at together; a longer text is looked at alone.
BATCH = 1 << 20


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is 0 modulo folds. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y): at most ``most`` labelled documents that are not held out, the same ones each time.

    They are the least by a hash of the id; so the side that is broadcast has at most ``most`` rows. Null labels and
    ids are left out; of several labels of a document the least counts, and of several texts of an id the one that sorts
    first, so the result has at most ``most`` rows too.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min(F.struct("text", "y")).alias("row"))
    return found.select("id", "row.text", "row.y")


def buffers(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches whose texts (bytes; null is empty) have BATCH bytes together, or one text."""
    for b in batches:
        texts = [t or b"" for t in b.column(text).cast(pa.binary()).to_pylist()]
        first, size = 0, 0
        for i, t in enumerate(texts):
            if i > first and size + len(t) > BATCH:
                yield b.slice(first, i - first), texts[first:i]
                first, size = i, 0
            size += len(t)
        if first < len(texts):
            yield b.slice(first), texts[first:]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
