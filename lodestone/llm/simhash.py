"""SimHash near-dedup by meet-in-the-middle ball hashing (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrays import U64
from lodestone.llm.chunks import checkpoint
from lodestone.llm.components import connected_components

SEED = 42
#: Leading bits of a variant that name its group. Each fingerprint goes to 1 + p + p (p - 1) / 2 groups for radius 4.
PREFIX_BITS = 10
#: Variants that are sorted at once; a larger group is split on further bits.
SORT_AT_ONCE = 1 << 21


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The 64-bit SimHash of a text's shingles: ASCII letters lower-cased, words between ASCII white space.

    Fewer words than a shingle has: one shingle of them all; none, or a null text: 0.
    """
    ws = (text or b"").lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    h = xxhash.xxh64_intdigest
    if len(ws) <= words:
        return h(joined, SEED)
    ends = list(accumulate(map(len, ws), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends)]
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])], dtype=U64)
    set_ = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        set_ += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()], dtype=U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def flips(bits: list[int], most: int) -> np.ndarray:
    """All masks of at most ``most`` of these bits."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)], dtype=U64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node tied to it by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            return root
        root = new


def collisions(fp: np.ndarray, left: np.ndarray, who: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Variants that more than one node makes, sorted, and the nodes that make them, sorted within a variant. left: flips
    each fingerprint may still make among its ``low`` lowest bits."""
    if len(fp) < 2:
        return
    most = int(left.max())
    counts = np.array([len(flips(list(range(low)), k)) if k < 2 else 1 + low + low * (low - 1) // 2 if k == 2 else 1 << 30 for k in range(most + 1)])
    if counts[left].sum() > SORT_AT_ONCE and low > 1:
        top = (fp >> U64(low - 1)) & U64(1)
        for bit in (0, 1):  # the variants that have this bit
            other = top != U64(bit)
            keep = ~other | (left > 0)
            yield from collisions(fp[keep], (left - other)[keep], who[keep], low - 1)
        return
    mask = U64((1 << low) - 1)
    variants, owners = [], []
    for k in range(most + 1):
        mine = left == k
        if mine.any():
            m = flips(list(range(low)), k)
            variants.append(((fp[mine] & mask)[:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(who[mine], len(m)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    bits = int(who.max()).bit_length()
    if low + bits <= 64:
        packed = np.sort((v << U64(bits)) | o.astype(U64))
        v, o = packed >> U64(bits), (packed & U64((1 << bits) - 1)).astype(np.int64)
    else:
        order = np.lexsort((o, v))
        v, o = v[order], o[order]
    same = v[1:] == v[:-1]
    some = np.concatenate((same, [False])) | np.concatenate(([False], same))
    if some.any():
        yield v[some], o[some]


def links(fps: DataFrame, radius: int = 4, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """(a, b): edges between representatives whose connected components are those of all pairs that differ in at most ``radius`` bits.

    fps: (fp, rep), a row for each distinct fingerprint. Meet in the middle: two fingerprints differ in at most
    ``radius`` bits exactly if they share a variant within half of it from each. Every fingerprint sends itself to
    each group of variants that have the same leading bits (by flipping up to half the radius of these bits); the
    group makes the variants, with the flips that are left, sorts them, and ties the owners of equal ones once their
    distance is verified. No pair is emitted: a group returns a forest, at most one edge for a fingerprint.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    half, p = radius // 2, prefix_bits
    masks = flips(list(range(64 - p, 64)), half).view(np.int64).tolist()
    spread = fps.select("fp", "rep", F.explode(F.array(*[F.lit(m) for m in masks])).alias("m"))
    groups = spread.select(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("m")), 64 - p).alias("g"), "fp", "rep")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, rep = pdf["fp"].to_numpy().astype(np.int64).view(U64), pdf["rep"].to_numpy()
        order = np.argsort(rep)
        fp, rep = fp[order], rep[order]
        away = np.bitwise_count((fp >> U64(64 - p)) ^ U64(int(pdf["g"].iloc[0])))
        low = 64 - p
        root = np.arange(len(fp))
        for v, o in collisions(fp, half - away.astype(np.int64), np.arange(len(fp)), low):
            at = np.flatnonzero(v[1:] == v[:-1])
            a, b = o[at], o[at + 1]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            a, b = a[near], b[near]
            root = _roots(len(fp), np.concatenate((a, np.arange(len(fp)))), np.concatenate((b, root)))
        tied = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": rep[tied], "b": rep[root[tied]]})

    return groups.groupBy("g").applyInPandas(run, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lowercase hex digits; component_id: the smallest doc_id that links of at most ``radius`` bits
    reach. Null and empty texts have fingerprint zero and link like any other. Rows with a null id link too, but
    never name a component; without any other id in it, its component_id is null. Repeated rows stay. Other columns
    of docs are not looked at.
    """
    fps = checkpoint(fingerprints(docs, words, id_col, text_col))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comps = components(nodes, radius)
    return fps.join(comps, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def components(nodes: DataFrame, radius: int) -> DataFrame:
    """(fp, component): nodes (fp, rep); the graph is over the fingerprints, and each component is named by its least rep."""
    edges = links(nodes.select("fp", F.col("fp").alias("rep")), radius)
    comps = connected_components(edges).select(F.col("id").alias("fp"), F.col("component").alias("c"))
    named = nodes.join(comps, "fp", "left").select("fp", "rep", F.coalesce("c", "fp").alias("c"))
    names = named.groupBy("c").agg(F.min("rep").alias("component"))
    return named.join(names, "c").select("fp", "component")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, shingles of 4 words, links of at most 4 bits."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
