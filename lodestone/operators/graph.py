"""Graphs over files and symbols: reference edges, PageRank, blast radius, communities, ancestry."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.names import alias_keys, bare_leaf


def _cut(df: DataFrame) -> DataFrame:
    """Ends an iteration's lineage in the shared checkpoint folder (below the warehouse where none is set)."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def file_edges(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, dst, weight): a reference gives each file that defines its exact name 1/N, its own file not among the N.

    References are counted by (file, name) first, so a name that very many use is joined once a file."""
    defs = entities.select("name", F.col("file").alias("dst")).distinct()
    uses = refs.groupBy(F.col("file").alias("src"), "name").agg(F.count("*").alias("uses"))
    hit = uses.join(defs, "name").where("src != dst")
    n = hit.groupBy("src", "name").agg(F.count("*").alias("n"))
    return hit.join(n, ["src", "name"]).groupBy("src", "dst").agg(F.sum(F.col("uses") / F.col("n")).alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight): both directions added."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """(id, rank) over nodes (id) and edges (src, dst, weight): weights are normalised by source, the mass of nodes
    without edges is shared by all, and it stops when the ranks move by less than ``tolerance`` together."""
    nodes = _cut(nodes.select("id").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    links = _cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    dangling = _cut(nodes.join(out.select(F.col("src").alias("id")), "id", "left_anti"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        lost = ranks.join(dangling, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = links.join(ranks, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = nodes.join(got, "id", "left").crossJoin(F.broadcast(lost))  # one row
        new = new.select("id", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if k == rounds - 1:
            return new
        new = _cut(new)
        if k % every == every - 1:
            moved = new.alias("a").join(ranks.alias("b"), "id").agg(F.sum(F.abs(F.col("a.rank") - F.col("b.rank")))).first()[0]
            if moved < tolerance:
                return new
        ranks = new
    return ranks


def expanded_refs(refs: DataFrame) -> DataFrame:
    """Every reference under each of its keys (see alias_keys), with ref_id, the hash of the row."""
    named = refs.withColumn("ref_id", F.xxhash64("file", "caller", "name", "kind", "line"))
    return named.select("*", F.explode(alias_keys(F.col("name"))).alias("key"))


def blast_direct(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """(file, name, parent, direct_callers, direct_files): references to a definition under its name, qualified name or leaf, each once."""
    forms = F.array_distinct(F.array_compact(F.array(F.col("name"), F.col("qualified_name"), bare_leaf(F.col("name")))))
    defs = entities.select("file", "name", "parent", F.explode_outer(forms).alias("key")).groupBy("file", "name", "parent").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    defs = defs.withColumn("set", F.xxhash64("keys"))
    # many definitions go by the same keys: references are counted once for each set of keys
    wanted = defs.groupBy("set").agg(F.first("keys").alias("keys")).select("set", F.explode("keys").alias("key"))
    used = expanded_refs(refs.select("file", "caller", "name", "kind", "line").distinct()).select("ref_id", F.col("file").alias("from_file"), "key")
    hit = wanted.join(used, "key").select("set", "ref_id", "from_file").distinct()
    # by file first: no distinct count is left for the second step
    per_file = hit.groupBy("set", "from_file").agg(F.count("*").alias("n"))
    counts = per_file.groupBy("set").agg(F.sum("n").alias("direct_callers"), F.count("*").alias("direct_files"))
    none = F.lit(0).cast("long")
    return defs.join(counts, "set", "left").select("file", "name", "parent", F.coalesce("direct_callers", none).alias("direct_callers"), F.coalesce("direct_files", none).alias("direct_files"))


def blast_transitive(seeds: DataFrame, refs: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, callers): how many distinct callers reach each seed name in at most ``depth`` steps over references.

    A step takes the callers of what the last one found; seeds aren't counted. The frontier holds each (seed, caller) once."""
    calls = expanded_refs(refs).where("caller is not null").select("key", "caller").distinct()
    calls = _cut(calls)
    seen = seeds.select(F.col("name").alias("seed"), F.col("name").alias("at")).distinct()
    frontier = seen
    for _ in range(depth):
        found = frontier.join(calls, F.col("at") == F.col("key")).select("seed", F.col("caller").alias("at")).distinct()
        frontier = _cut(found.join(seen, ["seed", "at"], "left_anti"))
        seen = seen.unionByName(frontier)
    counted = seen.where("seed != at").groupBy("seed").agg(F.count("*").alias("callers"))
    return seeds.select(F.col("name").alias("seed")).distinct().join(counted, "seed", "left").select("seed", F.coalesce("callers", F.lit(0)).alias("callers"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): the least node that each node of edges (a, b) can reach, by least labels passed on and shortcut."""
    both = _cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("component"))
    for _ in range(rounds):
        labels = _cut(labels)
        near = both.join(labels, F.col("y") == F.col("id")).groupBy(F.col("x").alias("id")).agg(F.min("component").alias("near"))
        hop = labels.select(F.col("id").alias("component"), F.col("component").alias("hop"))
        new = labels.join(near, "id").join(hop, "component", "left").select("id", F.least("component", "near", "hop").alias("new"), "component")
        new = _cut(new)
        if not new.where("new != component").limit(1).count():
            return labels
        labels = new.select("id", F.col("new").alias("component"))
    raise RuntimeError("components did not settle")


def ancestors(heritage: DataFrame, depth: int = 16) -> DataFrame:
    """(id, ancestor, level): all that each id inherits from over heritage (child, parent), the shortest way counts."""
    edges = _cut(heritage.select("child", "parent").distinct())
    found = edges.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("level"))
    frontier = found
    for level in range(2, depth + 1):
        more = frontier.join(edges, F.col("ancestor") == F.col("child")).select("id", F.col("parent").alias("ancestor"), F.lit(level).alias("level")).distinct()
        frontier = _cut(more.join(found, ["id", "ancestor"], "left_anti").where("id != ancestor"))
        if not frontier.limit(1).count():
            break
        found = found.unionByName(frontier)
    return found


def propagate(weights: dict[str, dict[str, float]], rounds: int = 30) -> dict[str, int]:
    """Label propagation in place: nodes in order take the label of most weight among their neighbours, ties to the
    lesser label; labels are renumbered by first appearance."""
    order = sorted(weights)
    label = {x: i for i, x in enumerate(order)}
    for _ in range(rounds):
        moved = False
        for x in order:
            votes: dict[int, float] = defaultdict(float)
            for y, w in weights[x].items():
                votes[label[y]] += w
            if votes:
                new = min(votes, key=lambda k: (-votes[k], k))
                moved |= new != label[x]
                label[x] = new
        if not moved:
            break
    numbers: dict[int, int] = {}
    return {x: numbers.setdefault(label[x], len(numbers)) for x in order}


def louvain(weights: dict[str, dict[str, float]], resolution: float = 1.0, rounds: int = 16) -> dict[str, int]:
    """Communities by local moving of positive gain, splitting what is not connected, and merging, again and again."""
    group = {x: i for i, x in enumerate(sorted(weights))}
    graph = {group[x]: {group[y]: w for y, w in sorted(ys.items())} for x, ys in weights.items()}
    total = sum(w for ys in graph.values() for w in ys.values()) or 1.0
    for _ in range(rounds):
        degree = {x: sum(ys.values()) for x, ys in graph.items()}
        of = {x: x for x in graph}
        size = dict(degree)
        moved, passes = True, 0
        while moved and passes < 50:
            moved, passes = False, passes + 1
            for x in sorted(graph):
                size[of[x]] -= degree[x]
                into: dict[int, float] = defaultdict(float)
                for y, w in graph[x].items():
                    if y != x:
                        into[of[y]] += w
                stay = into.get(of[x], 0.0) - resolution * degree[x] * size[of[x]] / total
                gains = {c: w - resolution * degree[x] * size[c] / total for c, w in into.items()}
                best = min(gains, key=lambda c: (-gains[c], c), default=of[x])
                if best != of[x] and gains[best] > stay + 1e-12:
                    of[x], moved = best, True
                size[of[x]] += degree[x]
        # a community that is not connected falls apart
        part: dict[int, int] = {}
        for x in sorted(graph):
            if x not in part:
                part[x] = x
                todo = [x]
                for y in todo:
                    for z in graph[y]:
                        if z not in part and of[z] == of[x]:
                            part[z] = x
                            todo.append(z)
        if len(set(part.values())) == len(graph):
            break
        merged: dict[int, dict[int, float]] = {c: defaultdict(float) for c in set(part.values())}
        for x, ys in graph.items():
            for y, w in ys.items():
                merged[part[x]][part[y]] += w
        graph = {x: dict(ys) for x, ys in merged.items()}
        group = {x: part[g] for x, g in group.items()}
    numbers: dict[int, int] = {}
    return {x: numbers.setdefault(group[x], len(numbers)) for x in sorted(group)}


def communities(edges: DataFrame, method: str = "louvain", component_limit: int = 2_000_000) -> DataFrame:
    """(id, community) over undirected edges (a, b, weight); numbers start from 0 in each connected component.

    Both methods look at nodes one after another, so a component is one task; components are found with joins first
    and worked on apart. File graphs are small beside the data they come from; a component of over
    ``component_limit`` edges is refused rather than left to fill a worker's memory."""
    comps = components(edges)
    tagged = edges.join(comps, F.col("a") == F.col("id")).select("component", "a", "b", "weight")
    largest = tagged.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > component_limit:
        raise ValueError(f"a component has {largest} edges")
    run = {"louvain": louvain, "labels": propagate}[method]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        weights: dict[str, dict[str, float]] = defaultdict(dict)
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"]):
            weights[a][b] = weights[a].get(b, 0.0) + w
            weights[b][a] = weights[b].get(a, 0.0) + w
        out = run(weights)
        return pd.DataFrame({"component": pdf["component"].iloc[0], "id": list(out), "community": list(out.values())})

    return tagged.groupBy("component").applyInPandas(work, "component string, id string, community int")
