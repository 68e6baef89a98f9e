"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking by the vectors (operator 3)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.chunks import checkpoint
from lodestone.llm.components import connected_components
from lodestone.llm.simhash import _roots

#: Vectors that the rotations are learnt from, at most.
SAMPLE = 4000
#: Share of the pairs at the threshold that may meet in no table, by the bits in which random directions would tell them apart.
MISSED = 0.001
#: Rows of a bucket that are compared in one piece; of a larger one, pieces are compared with each other.
PIECE = 2048


def directions(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): the vectors that can be compared, divided by their length, in double precision."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(fine)
    # scaled by the largest component first, so that no square overflows or vanishes
    top = plain.withColumn("top", F.array_max(F.transform("v", lambda x: F.abs(x)))).where("top > 0")
    scaled = top.select("id", F.transform("v", lambda x: x / F.col("top")).alias("v"))
    return scaled.select("id", F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))).alias("v"))


def itq(x: np.ndarray, seed: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of iterative quantisation (Gong and Lazebnik): principal components, then the rotation that
    brings the vectors nearest to the corners of a cube, by turns of signs and orthogonal Procrustes."""
    mean = x.mean(axis=0)
    z = x - mean
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    axes = np.vstack((axes, np.zeros((x.shape[1] - len(axes), x.shape[1])))) if len(axes) < x.shape[1] else axes
    v = z @ axes.T
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ r + 1e-300).T @ v)
        r = (u @ w).T
    return mean, axes.T @ r


def table_shape(rows: int, threshold: float) -> tuple[int, int]:
    """(bits of a table, tables): a bit for each doubling of the rows, so that buckets keep their size, and as many tables as
    MISSED asks for."""
    width = min(62, max(6, math.ceil(math.log2(max(2, rows / 64)))))
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    meet = min(same**width, 1 - 1e-9)
    return width, max(1, math.ceil(math.log(MISSED) / math.log1p(-meet)))


def table_keys(codes: np.ndarray, width: int, tables: int) -> np.ndarray:
    """codes (rows, bits) cut into tables of ``width`` bits: (rows, tables) of numbers."""
    cut = codes[:, : tables * width].reshape(len(codes), tables, width)
    return cut @ (1 << np.arange(width))


def near_vectors(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df.

    Pairs are found in multi-index Hamming tables: the bits of learnt, balanced codes are cut into tables, and two
    vectors meet where a table's bits agree; they link if their cosine, on the vectors themselves, reaches
    ``threshold``. A table has one bit for each doubling of the rows, so buckets keep their size, and there are as many
    tables as that width needs (see table_shape()): 13 of 8 bits at 10,000 rows, 35 of 16 at 4 million. Every rotation gives as
    many bits as the vectors have components. A bucket larger than PIECE is dealt out in pairs of pieces.
    A pair that meets in several tables counts in the first. Equal vectors are compared once, as one with a
    multiplicity. No pair is emitted: a task returns its rows' numbers of links and a forest.

    Null, zero and non-finite vectors, and those of another length than most, link with nothing; a null id gets no
    link, its own row and a null component. Rows with equal ids are told apart as vectors, and count as one id.
    """
    unit = checkpoint(directions(df, id_col, vec_col).distinct())
    shape = unit.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    ids = df.select(F.col(id_col).cast("long").alias("vec_id"))
    if shape is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    d = shape["d"]
    unit = unit.where(F.size("v") == d)
    # one row for each distinct vector; rep names it
    of = checkpoint(unit.groupBy("v").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("n")))
    total = of.count()
    learn = np.array([r["v"] for r in of.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()])
    width, number = table_shape(total, threshold)
    turns = [itq(learn, seed) for seed in range(-(-width * number // d))]

    def code(x: np.ndarray) -> np.ndarray:
        return table_keys(np.hstack([(x - mean) @ turn > 0 for mean, turn in turns]).astype(np.int64), width, number)

    def tables(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            keys = code(np.array(pdf["v"].tolist()))
            t = keys.shape[1]
            yield pd.DataFrame({"t": np.tile(np.arange(t), len(pdf)), "key": keys.ravel(), "rep": np.repeat(pdf["rep"].to_numpy(), t), "n": np.repeat(pdf["n"].to_numpy(), t), "v": [v for v in pdf["v"] for _ in range(t)]})

    rows = of.mapInPandas(tables, "t int, key long, rep long, n long, v array<double>")
    rows = checkpoint(rows.withColumn("v", F.transform("v", lambda x: x.cast("double"))))
    pieces = rows.groupBy("t", "key").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    dealt = rows.join(pieces, ["t", "key"]).withColumn("p", (F.pmod(F.xxhash64("rep"), F.col("pieces"))).cast("int"))
    # piece p meets every piece q: the pair (a, b), a <= b, is one group
    met = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = met.select("t", "key", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "p", "rep", "n", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        t, a, b = int(pdf["t"].iloc[0]), int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        pdf = pdf.sort_values("rep")
        x, rep, n, p = np.array(pdf["v"].tolist()), pdf["rep"].to_numpy(), pdf["n"].to_numpy(), pdf["p"].to_numpy()
        if len(rep) < 2 or (a != b and (p == a).all()):
            return pd.DataFrame({"rep": [], "links": [], "low": []}, dtype="int64")
        left, right = np.flatnonzero(p == a), np.flatnonzero(p == b)
        keys = code(x)[:, :t]
        links, ties = np.zeros(len(rep), dtype=np.int64), []
        for at in range(0, len(left), 256):
            l = left[at : at + 256]  # noqa: E741
            i, j = np.nonzero(x[l] @ x[right].T >= threshold)
            i, j = l[i], right[j]
            mine = (i != j) & ~(keys[i] == keys[j]).any(axis=1)
            i, j = i[mine], j[mine]
            np.add.at(links, i, n[j])
            if a != b:
                np.add.at(links, j, n[i])
            ties.append(np.unique(np.column_stack((np.minimum(i, j), np.maximum(i, j))), axis=0))
            # a forest is enough to go on with
            e = np.concatenate(ties)
            root = _roots(len(rep), e[:, 0], e[:, 1])
            ties = [np.column_stack((root, np.arange(len(rep))))[root != np.arange(len(rep))]]
        root = _roots(len(rep), ties[0][:, 0], ties[0][:, 1])
        some = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
        return pd.DataFrame({"rep": rep[some], "links": links[some], "low": rep[root[some]]})

    found = checkpoint(met.groupBy("t", "key", "a", "b").applyInPandas(compare, "rep long, links long, low long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    same = unit.join(of, "v").select("id", "rep", "n")
    linked = same.join(links, "rep", "left").groupBy("id").agg((F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1)).alias("n_links"))
    edges = found.select(F.col("rep").alias("a"), F.col("low").alias("b")).unionByName(same.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comps = connected_components(edges)
    out = ids.alias("i").join(linked.alias("l"), F.col("vec_id") == F.col("l.id"), "left").join(comps.alias("c"), F.col("vec_id") == F.col("c.id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op3_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of embeddings, cosine 0.95."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every pair compared.
ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a WHERE r.c < l.b)
SELECT m.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = m.vec_id) AS BIGINT) AS n_links, min(r.c) AS component_id, min(r.c) = m.vec_id AS kept
FROM embeddings m JOIN r ON r.id = m.vec_id GROUP BY m.vec_id
"""
QUERIES = {"op3_itq_dedup": op3_itq_dedup}
ORACLES = {"op3_itq_dedup": ORACLE_SQL}
