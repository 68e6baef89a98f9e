"""Mixing sources to target weights by pivotal dependent rounding (operator 10). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.chunks import checkpoint

#: Documents that one node of the reduction tree rounds against each other.
FAN_IN = 48
SEED = 20240229


def word_count(text: Column) -> Column:
    """The number of words between ASCII white space; 0 for null."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3 and so on, and share the sum of all sizes; a target stops
    at ``most`` times its source's size, and what is over is shared anew by weight. That is a common level: sorted
    by how soon they are full, the sources fill one after another, and the first that doesn't gives the level.
    """
    cap, w = F.col("source_size") * most, F.col("w")
    weighed = sizes.withColumn("w", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    by_level = Window.orderBy(F.col("full"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    levels = weighed.withColumn("full", cap / w).withColumn("level", (total - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("w").over(after))
    is_full = F.col("level") >= F.col("full")
    level = F.min(F.when(~is_full, F.struct("full", "level"))).over(everything)["level"]
    return levels.select("source", "source_size", F.when(is_full, cap.cast("double")).otherwise(w * level).alias("target"))


def _uniform(*of: Column) -> Column:
    """A number in [0, 1) that depends on the arguments alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *of), 11) / F.lit(float(1 << 53))


def _duel(acc: Column, j: Column, level: int) -> Column:
    """One step of pivotal rounding: the unit carried so far against unit j. Words move from one to the other, either
    way with the chance that keeps both expectations, until one is taken in full or not at all; the other is carried on."""
    i = acc["carry"]
    first = i["s"].isNull()
    to_i = F.least(i["s"] * (1 - i["p"]), j["s"] * j["p"])
    to_j = F.least(j["s"] * (1 - j["p"]), i["s"] * i["p"])
    up = (to_i + to_j == 0) | (_uniform(F.lit(level), i["id"], i["s"], j["id"], j["s"]) * (to_i + to_j) < to_j)
    i_full = i["s"] * (1 - i["p"]) <= j["s"] * j["p"]
    j_full = j["s"] * (1 - j["p"]) <= i["s"] * i["p"]

    def unit(x: Column, p: Column) -> Column:
        return F.struct(x["s"].alias("s"), x["id"].alias("id"), x["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    def done(x: Column, yes: bool) -> Column:
        return F.struct(x["id"].alias("id"), x["size"].alias("size"), F.lit(yes).alias("more"))

    carry = (
        F.when(first, unit(j, j["p"]))
        .when(up & i_full, unit(j, j["p"] - to_i / j["s"]))
        .when(up, unit(i, i["p"] + to_i / i["s"]))
        .when(j_full, unit(i, i["p"] - to_j / i["s"]))
        .otherwise(unit(j, j["p"] + to_j / j["s"]))
    )
    out = F.when(up & i_full, done(i, True)).when(up, done(j, False)).when(j_full, done(j, True)).otherwise(done(i, False))
    return F.struct(carry.alias("carry"), F.when(first, acc["done"]).otherwise(F.concat(acc["done"], F.array(out))).alias("done"))


_UNIT = "struct<s:double,id:bigint,size:bigint,p:double>"


def _round(units: DataFrame, level: int) -> DataFrame:
    """Rounds the units of each (source, node) against each other: ``done`` has the decided ones, ``carry`` the one that is left."""
    ordered = F.sort_array(F.collect_list("unit"), asc=False)  # long documents first, so that a short one is left
    start = F.struct(F.lit(None).cast(_UNIT).alias("carry"), F.array().cast("array<struct<id:bigint,size:bigint,more:boolean>>").alias("done"))
    folded = units.groupBy("source", "node").agg(ordered.alias("units"))
    folded = folded.select("source", "node", F.aggregate("units", start, lambda acc, j: _duel(acc, j, level)).alias("r"))
    return checkpoint(folded.select("source", "node", "r.carry", "r.done"))


#: Documents of a source and a class of sizes that may be taken once more or less at the end, and how often that is done.
SPARE = 8
TURNS = 2


def _settle(state: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, id, size, by): documents taken once more (1) or less (-1), which brings each source nearer its target.

    SPARE documents for each doubling of the size stand by in either direction, chosen by hash with partial
    aggregation; from the longest on, each is used that fits in what is left or nearly so."""
    taken = state.groupBy("source").agg(F.sum(F.col("size") * (F.col("whole") * F.col("n") + F.col("extra"))).alias("taken"))
    off = taken.alias("t").join(goals.alias("g"), F.expr("t.source <=> g.source")).select("g.source", (F.col("target") - F.col("taken")).alias("off"))
    off = off.select("source", F.signum("off").cast("int").alias("by"), F.abs("off").alias("left"))
    ways = F.array(F.when(F.col("extra") < F.col("n"), F.lit(1)), F.when(F.col("extra") > 0, F.lit(-1)))
    spare = state.where("p > 0 and size > 0").select("source", "id", "size", F.explode(ways).alias("by")).where("by is not null")
    draw = F.xxhash64(F.lit(SEED + 2), "id", "size")
    some = spare.groupBy("source", "by", F.floor(F.log2("size")).alias("class"), F.pmod(draw, F.lit(SPARE)).alias("salt")).agg(F.min(F.struct(draw.alias("draw"), "size", "id")).alias("unit"))
    lists = some.groupBy("source", "by").agg(F.sort_array(F.collect_list(F.struct("unit.size", "unit.id")), asc=False).alias("units"))
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<size:bigint,id:bigint>>").alias("used"))

    def use(acc: Column, u: Column) -> Column:
        fits = u["size"] <= acc["left"] * 1.125
        return F.struct(F.when(fits, acc["left"] - u["size"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["used"], F.array(u))).otherwise(acc["used"]).alias("used"))

    both = lists.alias("l").join(off.alias("o"), F.expr("l.source <=> o.source and l.by = o.by")).select("l.source", "l.by", "units", "left")
    return both.select("source", "by", F.explode(F.aggregate("units", start, use)["used"]).alias("u")).select("source", "u.id", "u.size", "by")


def decide(sized: DataFrame) -> DataFrame:
    """(source, id, size, n, whole, extra, source_size, target) for each distinct (source, id, size) of sized: of its n rows
    each is taken ``whole`` times, and ``extra`` of them once more.

    Every document of a source has the same fractional number of copies, target / source_size. The whole part is
    taken; the fractional parts are rounded by pivotal sampling in a tree: nodes of about FAN_IN documents, dealt by
    hash, round them against each other and pass one unrounded document up, until one is left of each source. Mass
    moves in words, so what a source then is off by is a part of the one document rounded last; _settle() makes up
    for that. Of n equal rows the whole part of n fractions is taken, and one row stands for the rest in the tree.
    Documents without words are rounded on their own.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = checkpoint(targets(per_source).withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))))
    units = sized.groupBy("source", "id", "size").agg(F.count("*").alias("n")).alias("u").join(goals.alias("g"), F.expr("u.source <=> g.source"))
    units = units.select("u.source", "id", "size", "n", "source_size", "target", F.floor("f").alias("whole"), ((F.col("f") - F.floor("f")) * F.col("n")).alias("part"))
    units = checkpoint(units.withColumn("sure", F.floor("part")).withColumn("p", F.col("part") - F.col("sure")).drop("part"))
    open_ = units.where("p > 0 and size > 0")
    nodes = open_.groupBy("source").agg(F.ceil(F.count("*") / FAN_IN).alias("nodes"))
    most = nodes.agg(F.max("nodes")).first()[0] or 0
    dealt = open_.alias("u").join(nodes.alias("k"), F.expr("u.source <=> k.source"))
    level = dealt.select(
        "u.source",
        F.pmod(F.xxhash64(F.lit(SEED + 1), "id", "size"), F.col("nodes")).alias("node"),
        F.struct(F.col("size").cast("double").alias("s"), "id", "size", "p").alias("unit"),
    )
    decided = []
    for k in range(64):
        done = _round(level, k)
        decided.append(done.select("source", F.explode("done").alias("d")).select("source", "d.id", "d.size", "d.more"))
        if most <= 1:
            last = done.select("source", "carry.*")
            decided.append(last.select("source", "id", "size", (_uniform(F.lit(-1), F.col("id"), F.col("s")) < F.col("p")).alias("more")))
            break
        most = -(-most // FAN_IN)
        level = done.select("source", F.expr(f"node div {FAN_IN}").alias("node"), F.col("carry").alias("unit"))
    rounded = decided[0]
    for d in decided[1:]:
        rounded = rounded.unionByName(d)
    joined = units.alias("u").join(rounded.alias("r"), F.expr("u.source <=> r.source and u.id <=> r.id and u.size = r.size"), "left")
    alone = _uniform(F.lit(-2), F.col("u.source"), F.col("u.id")) < F.col("p")
    extra = F.col("sure") + F.coalesce(F.col("r.more"), alone & (F.col("p") > 0)).cast("long")
    state = checkpoint(joined.select("u.source", "u.id", "u.size", "n", "whole", "p", extra.alias("extra"), "source_size", "target"))
    for _ in range(TURNS):
        again = _settle(state, goals)
        joined = state.alias("u").join(again.alias("a"), F.expr("u.source <=> a.source and u.id <=> a.id and u.size = a.size"), "left")
        state = checkpoint(joined.select("u.source", "u.id", "u.size", "n", "whole", "p", (F.col("extra") + F.coalesce("a.by", F.lit(0))).alias("extra"), "source_size", "target"))
    return state.drop("p")


def with_copies(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows (with source, id, size and maybe more) with copies, source_size and target. Equal rows are numbered, as far as
    there are any: within partitions of a checkpoint, so that a row that repeats very often isn't one task's."""
    key = "s.source <=> m.source and s.id <=> m.id and s.size = m.size"
    columns = [F.col(f"s.{c}") for c in rows.columns]
    one = rows.alias("s").join(made.where("n = 1").alias("m"), F.expr(key)).select(*columns, (F.col("whole") + F.col("extra")).alias("copies"), "source_size", "target")
    many = made.where("n > 1")
    if many.isEmpty():
        return one
    same = checkpoint(rows.alias("s").join(many.alias("m"), F.expr(key)).select(*columns, "whole", "extra", "source_size", "target"))
    same = same.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    unit = ["source", "id", "size"]
    before = Window.partitionBy(*unit).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = same.groupBy(*unit, "_part").agg(F.count("*").alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    placed = same.withColumn("_nth", F.row_number().over(Window.partitionBy(*unit, "_part").orderBy("_at")))
    joined = placed.alias("s").join(parts.alias("m"), F.expr(f"{key} and s._part = m._part"))
    more = (F.col("_before") + F.col("_nth") <= F.col("extra")).cast("long")
    return one.unionByName(joined.select(*columns, (F.col("whole") + more).alias("copies"), "source_size", "target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs.

    size: words; taken: copies * size, at most 3 times the size. A null text has no words; a null source is a source
    of its own, the last; null ids are an id. Of equal rows some may get one copy more than others. Without any words
    all targets are 0.
    """
    sized = checkpoint(docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("id"), word_count(F.col(text_col).cast("string")).alias("size")))
    out = with_copies(sized, decide(sized))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of docs as often as mix() takes it, with the columns of docs."""
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("id"), word_count(F.col(text_col).cast("string")).alias("size"))
    taken = with_copies(rows, decide(checkpoint(rows.select("source", "id", "size")))).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {}
