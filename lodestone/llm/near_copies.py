"""Near copies by SimHash: several fingerprints of a text's shingles, meet-in-the-middle ball hashing, every collision verified
by the Jaccard similarity of the shingles themselves (operator 1 in a pipeline, where the radius follows from a similarity)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays as A
from lodestone.llm.arrays import U64
from lodestone.llm.chunks import checkpoint
from lodestone.llm.components import connected_components
from lodestone.llm.labelled import buffers
from lodestone.llm.simhash import _roots, collisions, flips

#: Words of a shingle.
WORDS = 5
#: Fingerprints meet at so many differing bits or fewer: half of them from each side.
RADIUS = 4
#: Share of the pairs at the least similarity that may meet under none of the fingerprints.
MISSED = 0.005
#: Bits that a short text's fingerprints differ in beyond the limit of many shingles, as a share.
SHORT_TEXTS = 0.02
#: Further bits that tell whether a pair that met is worth verifying.
CHECK = 128
#: Fingerprints that a group has, at most.
GROUP = 1 << 20
#: Sets of a block that are compared in one piece; of more, pieces are compared with each other.
PIECE = 1024
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def differing(similarity: float) -> float:
    """The share of bits in which fingerprints of sets with this Jaccard similarity differ (sets of one size, the worst case)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shape(rows: int, similarity: float) -> tuple[int, int, int]:
    """(fingerprints, bits of one, leading bits that name a group): a bit for each doubling of the rows, so that few
    unlike texts meet, as many fingerprints as MISSED asks for, and groups of GROUP at most."""
    bits = min(56, max(24, max(1, rows).bit_length() + 14))
    p = differing(similarity) + SHORT_TEXTS
    meet = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(RADIUS + 1))
    prefix = 0
    while rows * sum(math.comb(prefix, k) for k in range(RADIUS // 2 + 1)) >> prefix > GROUP:
        prefix += 1
    return math.ceil(math.log(MISSED) / math.log(1 - meet)), bits, prefix


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Of every text the sorted distinct hashes of its shingles: ASCII letters lower-cased, words between ASCII white
    space. Fewer words than a shingle has: one shingle of them all; none: an empty set."""
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    starts, ends = A.word_spans(buf)
    hashes = A.word_hashes(buf, starts, ends)
    of = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    rolled = hashes
    for k in range(1, words):
        rolled = A.mix(rolled[: max(0, len(hashes) - k)] * U64(3)) + hashes[k:]
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        else:
            h = hashes[a : a + 1]
            for w in hashes[a + 1 : b]:
                h = A.mix(h * U64(3)) + w
            out.append(h + U64(b - a) if b > a else h[:0])
    return out


def fingerprints(shingles: np.ndarray, number: int, bits: int) -> list[int]:
    """SimHash fingerprints of a set that isn't empty, and CHECK more bits in two longs: bit by bit, whether it is set in
    over half of the shingles' hashes."""
    size = number * bits + CHECK
    salt = A.mix(np.arange(1, -(-size // 64) + 1, dtype=U64) * U64(0xD1342543DE82EF95))
    count = np.zeros(64 * len(salt), dtype=np.int64)
    for at in range(0, len(shingles), 255):  # so many fit a byte
        x = A.mix(shingles[at : at + 255, None] ^ salt)
        count += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    set_ = 2 * count > len(shingles)
    fps = set_[CHECK:size].reshape(number, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return np.packbits(set_[:CHECK], bitorder="little").view(np.int64).tolist() + fps.tolist()


def alike(groups: DataFrame, bits: int, prefix: int, similarity: float) -> DataFrame:
    """(a, b): a forest for each of groups (which, g, fp, c0, c1, s) over what shares a variant and whose further bits
    differ by clearly less than those of unlike sets. Of those that share a variant each is held against the two least
    and the next."""
    near = differing(similarity)
    limit = CHECK * (near + 0.4 * (0.5 - near))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        fp, c0, c1 = (pdf[c].to_numpy().astype(np.int64).view(U64) for c in ("fp", "c0", "c1"))
        s = pdf["s"].to_numpy()
        away = np.bitwise_count((fp >> U64(bits - prefix)) ^ U64(int(pdf["g"].iloc[0]))).astype(np.int64)
        every = root = np.arange(len(fp))
        for v, o in collisions(fp, RADIUS // 2 - away, every, bits - prefix):
            starts = A.starts_of_groups(v)
            sizes = np.diff(np.concatenate((starts, [len(v)])))
            first, at = np.repeat(starts, sizes), np.arange(len(v))
            second = np.minimum(first + 1, at)
            a = np.concatenate((o[first], o[second], o[np.maximum(at - 1, first)]))
            b = np.tile(o, 3)
            some = root[a] != root[b]
            a, b = a[some], b[some]
            close = np.bitwise_count(c0[a] ^ c0[b]).astype(np.int64) + np.bitwise_count(c1[a] ^ c1[b]) <= limit
            if close.any():
                root = _roots(len(fp), np.concatenate((a[close], every)), np.concatenate((b[close], root)))
        tied = np.flatnonzero(root != every)
        return pd.DataFrame({"a": s[tied], "b": s[root[tied]]})

    return groups.groupBy("which", "g").applyInPandas(run, "a long, b long")


def ties(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A forest whose trees are those of all pairs with at least this Jaccard similarity; no set is empty."""
    sizes = np.array([len(s) for s in sets])
    known, code = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    codes = np.split(code, starts[1:])
    left, out = np.ones(len(sets), dtype=bool), []
    open_ = np.arange(len(sets))  # those that were left when the arrays were last made smaller
    mine = np.zeros(len(known), dtype=bool)
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo and left.any():
            if 2 * left.sum() < len(open_):
                open_ = np.flatnonzero(left)
                code = np.concatenate([codes[i] for i in open_])
                starts = np.concatenate(([0], np.cumsum(sizes[open_])[:-1]))
            q = todo.pop()
            mine[codes[q]] = True
            both = np.add.reduceat(mine[code].astype(np.int64), starts)
            mine[codes[q]] = False
            near = open_[left[open_] & (both >= similarity * (sizes[open_] + sizes[q] - both) - 1e-9)]
            left[near] = False
            todo.extend(near.tolist())
            out.extend((q, i) for i in near.tolist())
    return out


def across(sets: list[np.ndarray], labels: np.ndarray, ask: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """For each set marked in ask one pair with every other label under which a set has at least this similarity to it."""
    sizes = np.array([len(s) for s in sets])
    known, code = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mine, out = np.zeros(len(known), dtype=bool), []
    for q in np.flatnonzero(ask).tolist():
        own = code[starts[q] : starts[q] + sizes[q]]
        mine[own] = True
        both = np.add.reduceat(mine[code].astype(np.int64), starts)
        mine[own] = False
        near = np.flatnonzero((labels != labels[q]) & (both >= similarity * (sizes + sizes[q] - both) - 1e-9))
        out.extend((q, int(near[i])) for i in np.unique(labels[near], return_index=True)[1])
    return out


def one_of_each(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, unchanged: the one with the smallest id, of a component without ids any one.

    Two texts link if the Jaccard similarity of their sets of shingles is at least ``similarity``; texts without a word
    are one component. Equal sets are one node. Each set has several fingerprints (see shape()); sets that meet under
    one, by variants within half the radius of each, and whose further bits differ by clearly less than those of
    unlike sets, are in one block. Within a block the sets themselves are compared (hashes of 64 bits for shingles): of
    a large block pieces with themselves and one common set first; then what this leaves outside the block's largest
    component is compared with all others. Rows are told apart by id and text, so rows with one id and unlike texts
    don't hide each other.
    """
    i, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number, bits, prefix = shape(docs.count(), similarity)
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("fps", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in buffers(batches, 2):
            sets = shingle_sets(texts)
            s = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype=U64).view(np.int64)
            fps = [fingerprints(x, number, bits) if len(x) else [0, 0] for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array(fps, pa.list_(pa.int64()))], schema=schema)

    plain = docs.select(i.alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = plain.mapInArrow(sketch, "id long, th long, s long, fps array<long>")
    # the first row of each set; a null id is later than any other
    nodes = checkpoint(rows.groupBy("s").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "th")).alias("row"), F.first("fps").alias("fps")))

    masks = flips(list(range(bits - prefix, bits)), RADIUS // 2).view(np.int64).tolist()
    each = nodes.select("s", F.col("fps")[0].alias("c0"), F.col("fps")[1].alias("c1"), F.posexplode(F.slice("fps", 3, number)).alias("which", "fp"))
    each = each.withColumn("m", F.explode(F.array(*map(F.lit, masks))))
    groups = each.select("which", F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("m")), bits - prefix).alias("g"), "fp", "c0", "c1", "s")
    forest = checkpoint(alike(groups, bits, prefix, similarity))
    blocks = checkpoint(connected_components(forest).select(F.col("id").alias("s"), F.col("component").alias("key")))
    sizes = blocks.groupBy("key").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    met = checkpoint(blocks.join(sizes, "key").select("key", "s", "pieces", F.pmod(F.xxhash64("s"), F.col("pieces")).cast("int").alias("p")))

    needed = met.join(nodes, "s").select("s", F.col("row.id").alias("id"), F.col("row.th").alias("th"))
    no = F.coalesce("id", F.lit(-1))
    texts = plain.withColumn("no", no).drop("id").join(needed.select("s", no.alias("no"), "th"), ["no", "th"]).dropDuplicates(["s"])
    content = pa.schema([("s", pa.int64()), ("set", pa.binary())])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ts in buffers(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in shingle_sets(ts)], pa.binary())], schema=content)

    sets = checkpoint(texts.select("s", "text").mapInArrow(full, "s long, set binary"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("s").sort_values("s")
        s = pdf["s"].to_numpy()
        found = ties([np.frombuffer(x, dtype=U64) for x in pdf["set"]], similarity)
        return pd.DataFrame([(s[a], s[b]) for a, b in found], columns=["a", "b"], dtype="int64")

    # a block is named by its least set, which every piece of it gets
    hubs = met.where("pieces > 1").select("key", "pieces").distinct().select("key", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("p"), F.col("key").alias("s"))
    first = met.select("key", "p", "s").unionByName(hubs).join(sets, "s")
    edges = checkpoint(first.groupBy("key", "p").applyInPandas(compare, "a long, b long"))
    comps = checkpoint(connected_components(edges).select(F.col("id").alias("s"), "component"))
    large = met.where("pieces > 1").select("key", "s")
    if not large.isEmpty():
        labelled = checkpoint(large.join(comps, "s", "left").select("key", "s", F.coalesce("component", "s").alias("label")))
        main = labelled.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"))
        main = main.select("key", F.col("main.label").alias("main"), F.ceil(F.col("main.n") / PIECE).alias("inner"), F.ceil((F.col("n") - F.col("main.n")) / PIECE).alias("outer")).where("outer > 0")
        dealt = labelled.join(main, "key").withColumn("out", F.col("label") != F.col("main")).withColumn("p", F.pmod(F.xxhash64("s"), F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner"))))
        outside = F.sequence(F.lit(0).cast("long"), F.col("outer") - 1)
        # group (i, j): piece i of what is outside with piece j of it, or, j below 0, with a piece of the largest component
        ours = F.transform(outside, lambda q: F.struct(F.least("p", q).alias("i"), F.greatest("p", q).alias("j")))
        inner = F.transform(F.sequence(F.lit(1).cast("long"), F.col("inner")), lambda q: F.struct(F.col("p").alias("i"), (-q).alias("j")))
        theirs = F.transform(outside, lambda q: F.struct(q.alias("i"), (-1 - F.col("p")).alias("j")))
        dealt = dealt.select("key", "s", "label", "out", F.explode(F.when(F.col("out"), F.concat(ours, inner)).otherwise(theirs)).alias("at")).select("key", "at.*", "s", "label", "out")

        def others(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("s")
            s = pdf["s"].to_numpy()
            found = across([np.frombuffer(x, dtype=U64) for x in pdf["set"]], pdf["label"].to_numpy(), pdf["out"].to_numpy(bool), similarity)
            return pd.DataFrame([(s[a], s[b]) for a, b in found], columns=["a", "b"], dtype="int64")

        more = dealt.join(sets, "s").groupBy("key", "i", "j").applyInPandas(others, "a long, b long")
        comps = connected_components(checkpoint(edges.unionByName(more))).select(F.col("id").alias("s"), "component")

    named = nodes.join(comps, "s", "left").groupBy(F.coalesce("component", "s").alias("c")).agg(F.min("row").alias("row"))
    stay = named.select(F.coalesce("row.id", F.lit(-1)).alias("_no"), F.col("row.no").alias("_null"), F.col("row.th").alias("_th"))
    asked = docs.withColumn("_no", F.coalesce(i, F.lit(-1))).withColumn("_null", i.isNull()).withColumn("_th", F.xxhash64(text))
    return asked.join(stay, ["_no", "_null", "_th"], "left_semi").dropDuplicates(["_no", "_null", "_th"]).select(*docs.columns)
