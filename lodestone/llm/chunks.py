"""Documents in chunks, and questions that chunks put to hash buckets.

Operators that compare every piece of every text would shuffle a row for each piece. Here the texts travel a few
hundred kilobytes at a time: a *chunk* is one row with many documents, compressed. A chunk asks with one row for each
bucket of hashes, which holds its own sorted keys once each (so a key that a third of all documents share comes once
from each chunk); a bucket answers with one row for each chunk that asked. Every step is an ordinary DataFrame
exchange, so a lost executor's part is computed again from the chunks, which are checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrays import U64

#: Bytes of text in a chunk. A longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Stands for a missing document id: later than any other.
NO_ID = (1 << 63) - 1

CHUNK_SCHEMA = "chunk long, docs binary"
ASK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
ASK_SCHEMA = "bucket int, chunk long, blob binary"
ANSWER_SCHEMA = "chunk long, blob binary"


#: Has Spark remove a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cleaned(df: DataFrame) -> DataFrame:
    """df as a query of its own, whose shuffle files are removed when it ends."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*")  # what a query cleans up is settled when it is made
    finally:
        spark.conf.set(CLEANUP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint(), in spark.checkpoint.dir; where that is unset (tests), in a folder below the warehouse. The shuffle
    files that led to it are removed: nothing reads them again, and a lost executor's part is read from the checkpoint."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return cleaned(df).checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text for each bucket, at most, where that makes more buckets than there are partitions.
BUCKET_BYTES = 32 << 20


def buckets(chunks: DataFrame, most: int = CHUNK_BYTES) -> int:
    """How many buckets the chunks (of at most ``most`` bytes) should ask, so that one holds a bounded part of the text."""
    return max(partitions(chunks.sparkSession), -(-chunks.count() * most // BUCKET_BYTES))


def dump(ids: list, texts: list, rest: pa.Array | None = None) -> bytes:
    """Documents as one compressed value. texts: bytes or None; rest: what else their rows have."""
    columns = {"id": pa.array([None if x is None else int(x) for x in ids], pa.int64()), "text": pa.array(texts, pa.binary())}
    table = pa.table(columns | ({} if rest is None else {"rest": rest}))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.ZstdCompressor(level=6).compress(sink.getvalue())


def table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(bytes(blob))).read_all()


def load(blob: bytes) -> tuple[list, list]:
    """Ids and texts (bytes, or None) of a chunk."""
    t = table(blob)
    return t.column("id").to_pylist(), t.column("text").to_pylist()


def load_rest(blob: bytes) -> pa.Array:
    return table(blob).column("rest").combine_chunks()


def _chunked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base, seq = TaskContext.get().partitionId() << 32, 0
    ids: list = []
    texts: list = []
    rest: list = []
    size = 0

    def out():
        nonlocal ids, texts, rest, size, seq
        blob = dump(ids, texts, pa.concat_arrays(rest) if rest else None)
        batch = pa.record_batch([pa.array([base + seq], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "docs"])
        ids, texts, rest, size, seq = [], [], [], 0, seq + 1
        return batch

    for b in batches:
        first = 0
        for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())):
            if ids and size + len(t or b"") > most:
                if b.num_columns > 2 and k > first:
                    rest.append(b.column(2).slice(first, k - first))
                first = k
                yield out()
            ids.append(i)
            texts.append(t)
            size += len(t or b"") + 16
        if b.num_columns > 2:
            rest.append(b.column(2).slice(first))
    if ids:
        yield out()


def make_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = CHUNK_BYTES, rest: list[str] | None = None) -> DataFrame:
    """(chunk, docs): all documents, hashed by chunk and checkpointed, so that later joins on chunk don't move them again.

    rest: columns that travel along, for load_rest()."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*map(F.col, rest)).alias("rest")] if rest else []))
    rows = plain.mapInArrow(lambda batches: _chunked(batches, most), CHUNK_SCHEMA).repartition(partitions(spark), "chunk")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan's checkpoint forgets how it is partitioned
    try:
        out = checkpoint(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    return out


def split_by_bucket(chunk: int, n: int, key: np.ndarray, pack_rows: Callable[[np.ndarray], bytes]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket of the keys; pack_rows gets the places that go to it, in the order given."""
    if not len(key):
        return
    bucket = (((key * U64(0x9E3779B97F4A7C15)) >> U64(32)) % U64(n)).astype(np.uint16 if n < 65536 else np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    blobs = [pack_rows(part) for part in np.split(order, first[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.full(len(found), chunk, np.int64)), pa.array(blobs, pa.binary())], schema=ASK)


def ask(chunks: DataFrame, emit: Callable[[dict], Iterator[pa.RecordBatch]]) -> DataFrame:
    """emit(row of chunks) yields batches of ASK."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from emit(b.slice(i, 1).to_pylist()[0])

    return chunks.mapInArrow(run, ASK_SCHEMA)


def answer(asked: DataFrame, reduce: Callable[[list, list], list], as_bytes: bool = True) -> DataFrame:
    """(chunk, blob): reduce(chunk ids, blobs) of a bucket gives the blob for each of these chunks, or None."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = reduce(pdf["chunk"].tolist(), pdf["blob"].tolist())
        keep = [i for i, b in enumerate(out) if b is not None]
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[keep].to_numpy("int64"), "blob": [out[i] for i in keep]})

    return asked.groupBy("bucket").applyInPandas(run, ANSWER_SCHEMA)


def with_answers(chunks: DataFrame, answers: DataFrame, name: str, how: str = "left") -> DataFrame:
    """chunks with an array of the blobs that were sent to each."""
    got = answers.groupBy("chunk").agg(F.collect_list("blob").alias(name))
    return chunks.join(got.hint("shuffle_merge"), "chunk", how)
