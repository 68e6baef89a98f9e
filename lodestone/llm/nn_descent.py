"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy graph search (operator 6)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.chunks import checkpoint, partitions

#: Neighbours that a node keeps; as many of the nodes that have it as a neighbour join them in the graph.
NEIGHBOURS = 24
#: Vectors in a leaf of the trees that the graph starts from.
LEAF = 320
#: Trees for each doubling of the rows beyond a leaf: 6 up to about 20,000 vectors.
TREES = 1
LEAST_TREES = 6
#: Rounds go on until one changes no more than this share of the edges.
SETTLED = 0.01
#: Vectors that the trees' splits are learnt from and that searches start at: one in SHARE, within these bounds.
SAMPLE, MOST_SAMPLE, SHARE = 2048, 1 << 15, 64
#: Nodes that a search keeps, and that it visits in a step.
BEAM = 384
WIDTH = 128
#: Doublings of the length that vectors of one graph differ by, at most.
RANGE = 2


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the vectors that take part, in double precision."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    plain = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return plain.where(fine).where(F.exists("v", lambda x: x != 0))


def _matrix(col: pd.Series) -> np.ndarray:
    """Equal-length float32 vectors kept as bytes."""
    return np.frombuffer(b"".join(col), dtype="<f4").reshape(len(col), -1)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list begins and ends in the values, and the values. A null is an empty list."""
    sizes = np.array(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.concatenate(([0], np.cumsum(sizes))), column.flatten()


def _rows(column: pa.BinaryArray) -> np.ndarray:
    """_matrix() of a column without nulls, without a copy."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view("<f4").reshape(len(column), -1) if len(column) else np.zeros((0, 1), "<f4")


def _best(sim: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row, largest first."""
    k = min(k, sim.shape[1])
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable"), 1)


class Trees:
    """Random hyperplane trees of equal depth, split at the medians of a sample, where that has none halfway between two of its
    vectors; leaves are numbers."""

    def __init__(self, x: np.ndarray, depth: int, trees: int = LEAST_TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, []
        for _ in range(trees):
            planes, leaf = [], np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                a, b = x[rng.integers(0, len(x), 2)]
                direction = a - b if (a != b).any() else rng.normal(size=x.shape[1])
                side = x @ direction
                cuts = {int(n): float(np.median(side[leaf == n])) for n in np.unique(leaf)}
                planes.append((direction, cuts, float((a + b) @ direction / 2)))
                leaf = 2 * leaf + (side > np.array([cuts[n] for n in leaf.tolist()]))
            self.trees.append(planes)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.trees)), dtype=np.int64)
        for t, planes in enumerate(self.trees):
            leaf = out[:, t]
            for direction, cuts, halfway in planes:
                known, first = np.unique(leaf, return_inverse=True)
                cut = np.array([cuts.get(int(n), halfway) for n in known])
                leaf = 2 * leaf + (x @ direction > cut[first])
            out[:, t] = leaf
        return out


_EDGES = "id long, other array<long>, sim array<float>"
_PAIRS = pa.schema([("id", pa.int64()), ("d", pa.float32()), ("o", pa.int64())])


def _nearest(pairs: DataFrame, k: int, by: str = "id") -> DataFrame:
    """(by, near): of pairs (by, d, o) for each ``by`` the k least (d, o), in order. Every task keeps k before they meet, so
    one that has very many is no burden."""
    ranked = pairs.withColumn("at", F.dense_rank().over(Window.partitionBy(by).orderBy("d", "o"))).where(F.col("at") <= k)
    return ranked.groupBy(by).agg(F.sort_array(F.collect_set(F.struct("d", "o"))).alias("near"))


def _pairs(graph: DataFrame) -> DataFrame:
    """(id, d, o) for each entry of a graph's lists; d is less the nearer o is."""
    return graph.select("id", F.explode(F.arrays_zip("other", "sim")).alias("e")).select("id", (-F.col("e.sim")).alias("d"), F.col("e.other").alias("o"))


def _merge(pairs: DataFrame, k: int) -> DataFrame:
    """(id, other, sim): for every node of (id, d, o) the k nearest others, nearest first."""
    near = _nearest(pairs, k)
    return near.select("id", F.transform("near", lambda p: p["o"]).alias("other"), F.transform("near", lambda p: (-p["d"]).cast("float")).alias("sim"))


def start_graph(nodes: DataFrame, trees: Trees, k: int) -> DataFrame:
    """Every node's nearest in its leaf of each tree. A leaf larger than four times LEAF is dealt out by hash."""

    def leaves(batches):
        for pdf in batches:
            if len(pdf):
                leaf = trees.leaves(_matrix(pdf["x"]))
                t = leaf.shape[1]
                yield pd.DataFrame({"tree": np.tile(np.arange(t), len(pdf)), "leaf": leaf.ravel(), "id": np.repeat(pdf["id"].to_numpy(), t), "x": [x for x in pdf["x"] for _ in range(t)]})

    rows = nodes.select("id", "x").mapInPandas(leaves, "tree int, leaf long, id long, x binary")
    parts = rows.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (4 * LEAF)).alias("parts"))
    rows = rows.join(parts, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), "parts"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(pdf["x"]), pdf["id"].to_numpy()
        if len(ids) < 2:
            return pd.DataFrame({"id": ids[:0], "other": pd.Series([], dtype=object), "sim": pd.Series([], dtype=object)})
        sim = x @ x.T
        np.fill_diagonal(sim, -np.inf)
        top = _best(sim, min(k, len(ids) - 1))
        return pd.DataFrame({"id": ids, "other": list(ids[top]), "sim": list(np.take_along_axis(sim, top, 1))})

    return _merge(_pairs(rows.groupBy("tree", "leaf", "part").applyInPandas(near, _EDGES)), k)


def both_ways(graph: DataFrame, k: int) -> DataFrame:
    """(id, other): every node's neighbours and up to k of the nodes that have it as a neighbour, the nearest of these."""
    nearest = _nearest(_pairs(graph).select(F.col("o").alias("id"), "d", F.col("id").alias("o")), k)
    joined = graph.join(nearest, "id", "full")
    mine = F.coalesce("other", F.array().cast("array<long>"))
    return joined.select("id", F.array_distinct(F.concat(mine, F.coalesce(F.transform("near", lambda p: p["o"]), F.array().cast("array<long>")))).alias("other"))


def with_vectors(links: DataFrame, nodes: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(id, others: array of (o, x)): the neighbours of each node with their vectors. more: (id, worst), added to each neighbour."""
    vectors = nodes.select(F.col("id").alias("o"), "x")
    extra = []
    if more is not None:
        vectors = vectors.join(more.select(F.col("id").alias("o"), "worst"), "o", "left")
        extra = ["worst"]
    flat = links.select("id", F.explode("other").alias("o")).join(vectors, "o")
    return flat.groupBy("id").agg(F.collect_list(F.struct("o", "x", *extra)).alias("others"))


def improve(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One round of NN-descent: the neighbours of a node are introduced to each other; each keeps the nearest k of old and new.
    fresh: how many of them it didn't have.

    A neighbour hears of another only if that is nearer than the farthest it has, and of the k nearest at most from one node."""
    worst = graph.select("id", F.when(F.size("sim") >= k, F.element_at("sim", -1)).otherwise(F.lit(-1e30)).cast("float").alias("worst"))
    met = with_vectors(both_ways(graph, k), nodes, worst)

    def introduce(batches):
        for b in batches:
            ends, flat = _lists(b.column(0))
            x, o, worst = _rows(flat.field("x")), flat.field("o").to_numpy(), flat.field("worst").to_numpy()
            found = []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if e - s < 2:
                    continue
                sim = x[s:e] @ x[s:e].T
                np.fill_diagonal(sim, -np.inf)
                top = _best(sim, k)
                near = np.take_along_axis(sim, top, 1)
                i, j = np.nonzero(near > worst[s:e, None])
                found.append((o[s + i], -near[i, j], o[s + top[i, j]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=_PAIRS)

    news = met.select("others").mapInArrow(introduce, "id long, d float, o long")
    pairs = _pairs(graph).withColumn("had", F.lit(True)).unionByName(news.withColumn("had", F.lit(False)))
    best = pairs.withColumn("at", F.dense_rank().over(Window.partitionBy("id").orderBy("d", "o"))).where(F.col("at") <= k)
    near = best.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("d", "o"))).alias("near"), F.size(F.collect_set(F.when(F.col("had"), F.col("o")))).alias("kept"))
    return near.select("id", F.transform("near", lambda p: p["o"]).alias("other"), F.transform("near", lambda p: (-p["d"]).cast("float")).alias("sim"), (F.size("near") - F.col("kept")).alias("fresh"))


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, starts: tuple[np.ndarray, np.ndarray], beam: int = BEAM, width: int = WIDTH) -> DataFrame:
    """(qid, found: array of ids): greedy search. Every query keeps its ``beam`` nearest nodes so far, and in a step
    visits the ``width`` nearest that it hasn't yet, until it has visited all that it keeps; it starts at the nearest
    of ``starts``, a bounded sample."""
    adjacent = checkpoint(with_vectors(both_ways(graph, NEIGHBOURS), nodes))
    start_ids, start_x = starts

    def begin(batches):
        for pdf in batches:
            if len(pdf):
                sim = _matrix(pdf["q"]) @ start_x.T
                top = _best(sim, min(beam, len(start_ids)))
                yield pd.DataFrame({"qid": pdf["qid"], "q": pdf["q"], "ids": list(start_ids[top]), "sims": list(np.take_along_axis(sim, top, 1)), "seen": [[] for _ in range(len(pdf))]})

    state_ddl = "qid long, q binary, ids array<long>, sims array<float>, seen array<long>"
    state = checkpoint(queries.select("qid", "q").mapInPandas(begin, state_ddl))

    got_schema = pa.schema([("qid", pa.int64()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32()))])
    state_schema = pa.schema([("qid", pa.int64()), ("q", pa.binary()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("seen", pa.list_(pa.int64()))])

    def visit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ends, flat = _lists(b.column(2))
            x, q = _rows(flat.field("x")), _rows(b.column(1))
            sims = np.einsum("ij,ij->i", x, np.repeat(q, np.diff(ends), axis=0))
            places = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(places, flat.field("o")), pa.ListArray.from_arrays(places, pa.array(sims))], schema=got_schema)

    def next_state(batches):
        for b in batches:
            if not b.num_rows:
                continue
            had, old, old_sims, more = (b.column(b.schema.get_field_index(c)) for c in ("seen", "ids", "sims", "more"))
            ends, flat = _lists(old)
            flat, flat_sims = flat.to_numpy(), _lists(old_sims)[1].to_numpy()
            outer, lists = _lists(more)
            inner, new = _lists(lists.field("ids"))
            new, new_sims = new.to_numpy(), _lists(lists.field("sims"))[1].to_numpy()
            ids, sims = [], []
            for k in range(b.num_rows):
                a, e = inner[outer[k]], inner[outer[k + 1]]
                i = np.concatenate((flat[ends[k] : ends[k + 1]], new[a:e]))
                s = np.concatenate((flat_sims[ends[k] : ends[k + 1]], new_sims[a:e]))
                i, first = np.unique(i, return_index=True)
                s = s[first]
                o = np.lexsort((i, -s))[:beam]
                ids.append(i[o])
                sims.append(s[o])
            seen = [np.concatenate((x, y)) for x, y in zip(had.to_numpy(zero_copy_only=False), b.column(b.schema.get_field_index("next")).to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float32())), pa.array(seen, pa.list_(pa.int64()))], schema=state_schema)

    unseen = F.filter("ids", lambda i: ~F.array_contains("seen", i))
    done = None
    while True:
        over = state.where(F.size(unseen) == 0).select("qid", F.col("ids").alias("found"))
        done = over if done is None else done.unionByName(over)
        chosen = state.withColumn("next", F.slice(unseen, 1, width)).where(F.size("next") > 0)
        if chosen.isEmpty():
            return done
        todo = chosen.select("qid", "q", F.explode("next").alias("id"))
        got = todo.join(adjacent, "id").select("qid", "q", "others").mapInArrow(visit, "qid long, ids array<long>, sims array<float>")
        more = got.groupBy("qid").agg(F.collect_list(F.struct("ids", "sims")).alias("more"))
        state = checkpoint(chosen.join(more, "qid", "left").select("qid", "q", "ids", "sims", "seen", "next", "more").mapInArrow(next_state, state_ddl))


def nearest(df: DataFrame, query: F.Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows with the largest inner product of each row that ``query`` (a condition on ``id``) holds for.

    Returns query_id, rank (from 1), vec_id and score, nearest first, ties to the smaller id; score is the inner
    product of the original vectors in double precision. The row itself is no candidate; rows with equal ids are one
    (the vector that sorts first counts). Vectors that are null, zero, of another length than most, or hold null or
    non-finite components take no part, nor do null ids.

    Equal vectors are one node of a graph. Inner products are made cosines by one more component, so that all
    nodes have one length (Bachrach et al. 2014); so that this tells short vectors apart too, those that differ by more
    than RANGE doublings in length are in graphs of their own, and every query searches each. Graphs and searches work
    in single precision, and what a search has kept is reranked with the original vectors. Of a range with BEAM nodes
    or fewer all are reranked, so there nothing is approximate.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    shape = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape is None:
        return empty
    rows = checkpoint(rows.where(F.size("v") == shape["d"]).groupBy("id").agg(F.min("v").alias("v")))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = F.aggregate(F.transform("v", lambda x: x / top), F.lit(0.0), lambda a, b: a + b * b)
    classes = checkpoint(rows.groupBy("v").agg(F.min("id").alias("rep")).withColumn("doublings", F.log2(top) + F.log2(scaled) / 2))
    longest = classes.agg(F.max("doublings")).first()[0]
    ranged = classes.withColumn("range", F.floor((F.lit(longest) - F.col("doublings")) / RANGE))
    sizes = {r["range"]: (r["n"], r["longest"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.max("doublings").alias("longest")).collect()}

    def query_vectors(batches):
        for pdf in batches:
            if len(pdf):
                v = np.array(pdf["v"].tolist())
                v /= np.abs(v).max(axis=1)[:, None]
                x = np.column_stack((v / np.sqrt((v**2).sum(axis=1))[:, None], np.zeros(len(v)))).astype("<f4")
                yield pd.DataFrame({"qid": pdf["id"], "q": [r.tobytes() for r in x]})

    asked = rows.where(query)
    asking = asked.mapInPandas(query_vectors, "qid long, q binary")
    few = [r for r, (n, _) in sizes.items() if n <= BEAM]
    found = asked.select(F.col("id").alias("qid")).join(F.broadcast(ranged.where(F.col("range").isin(few)).agg(F.collect_list("rep").alias("found"))), how="cross") if few else None
    for r, (n, longest) in sorted(sizes.items()):
        if n > BEAM:
            nodes = lifted(ranged.where(F.col("range") == r), longest)
            some = nodes.orderBy(F.xxhash64("id"), "id").limit(min(MOST_SAMPLE, max(SAMPLE, n // SHARE))).select("id", "x").toPandas()
            starts = some["id"].to_numpy(), _matrix(some["x"])
            got = search(asking, settled_graph(nodes, n, starts[1]), nodes, starts)
            found = got if found is None else found.unionByName(got)
    # the k + 1 smallest ids of every class: more can't be among the k nearest
    of = rows.join(classes.select("v", "rep"), "v").select("rep", F.lit(0).alias("d"), F.col("id").alias("o"))
    members = _nearest(of, k + 1, "rep").select("rep", F.transform("near", lambda p: p["o"]).alias("ids"))
    flat = found.select("qid", F.explode("found").alias("rep")).join(classes.select("rep", "v"), "rep")
    mine = flat.join(asked.select(F.col("id").alias("qid"), F.col("v").alias("q")), "qid")
    score = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    near = mine.select("qid", "rep", score.alias("score")).join(members, "rep")
    pairs = near.select("qid", F.explode("ids").alias("id"), "score").where("id != qid")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def lifted(classes: DataFrame, longest: float) -> DataFrame:
    """(id, x): vectors (rep, v, doublings) over the length of the longest, given by its doublings, with one more component that makes their length 1."""

    def lift(batches):
        for pdf in batches:
            if len(pdf):
                v = np.array(pdf["v"].tolist())
                v /= np.abs(v).max(axis=1)[:, None]
                v /= np.sqrt((v**2).sum(axis=1))[:, None]
                v *= np.exp2(pdf["doublings"].to_numpy() - longest)[:, None]
                x = np.column_stack((v, np.sqrt(np.maximum(0, 1 - (v**2).sum(axis=1))))).astype("<f4")
                yield pd.DataFrame({"id": pdf["rep"], "x": [r.tobytes() for r in x]})

    return checkpoint(classes.select("rep", "v", "doublings").mapInPandas(lift, "id long, x binary").repartition(partitions(classes.sparkSession), "id"))


def settled_graph(nodes: DataFrame, total: int, sample: np.ndarray) -> DataFrame:
    """The graph of NEIGHBOURS from hyperplane trees, improved until a round changes no more than SETTLED of its edges."""
    depth = max(0, math.ceil(math.log2(max(1, total / LEAF))))
    graph = checkpoint(start_graph(nodes, Trees(sample, depth, max(LEAST_TREES, TREES * depth)), NEIGHBOURS))
    while total > LEAF:
        better = checkpoint(improve(graph, nodes, NEIGHBOURS))
        changed = better.agg(F.sum("fresh")).first()[0]
        graph = better.drop("fresh")
        if (changed or 0) <= SETTLED * NEIGHBOURS * total:
            break
    return graph


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of embeddings; queries are the rows whose vec_id is divisible by 20, 20 nearest each."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


QUERIES = {"op6_nn_descent": op6_nn_descent}
ORACLES: dict[str, str] = {}
