"""Resolution of references to definitions: through imports, classes, manifests, and across repositories.

Every step is equi-joins on exploded keys. Manifest tables (prefixes, modules) are small but nothing says how small,
so no side is broadcast by hint: the planner does so where it knows the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.names import bare_leaf, is_test_path, language, tail_segment

#: What a module path may stand for, in the order in which it is tried. Fixed values.
SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py"]
CALLABLE = ["function", "method", "class", "struct", "interface", "enum"]


def normal_path(path):
    """A path without empty and ``.`` segments, each ``..`` taking back the segment before it; a leading ``..`` is dropped."""
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def module_files(imports: DataFrame, files: DataFrame, rewrites: DataFrame | None = None) -> DataFrame:
    """imports(file, module) with the file (target) that the module path means: the first of its candidates that exists.

    A path that starts with ``.`` and a slash is relative to the importing file; leading dots of a Python path go up a
    package each; dots are slashes then. rewrites(prefix, dir): a path's longest prefix (cut at slashes) is replaced first."""
    m = F.col("module")
    here = F.regexp_extract("file", "^(.*?)/?[^/]*$", 1)
    ups = F.length(F.regexp_extract(m, r"^(\.+)[^/.]?", 1))
    python = language(F.col("file")) == "python"
    each = imports.select("file", "module").distinct()
    if rewrites is not None:
        parts = F.split(m, "/")
        own = each.select("file", "module", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")).withColumn("prefix", F.array_join(F.slice(F.split("module", "/"), F.lit(1), F.col("n")), "/"))
        best = own.join(rewrites.select("prefix", "dir"), "prefix").groupBy("file", "module").agg(F.max(F.struct("n", "prefix", "dir")).alias("b"))
        each = each.join(best, ["file", "module"], "left").withColumn("path", F.when(F.col("b").isNotNull(), F.concat("b.dir", F.expr("substring(module, length(b.prefix) + 1)"))))
    else:
        each = each.withColumn("path", F.lit(None).cast("string"))
    relative = F.concat_ws("/", here, m)
    climbed = F.concat_ws("/", here, F.array_join(F.array_repeat(F.lit(".."), F.greatest(ups - 1, F.lit(0)).cast("int")), "/"), F.translate(F.regexp_replace(m, r"^\.+", ""), ".", "/"))
    base = F.coalesce("path", F.when(python & m.startswith("."), climbed).when(python, F.translate(m, ".", "/")).when(m.startswith("./") | m.startswith("../"), relative).otherwise(m))
    tried = each.select("file", "module", normal_path(base).alias("base")).select("file", "module", F.posexplode(F.array(F.col("base"), *(F.concat("base", F.lit(s)) for s in SUFFIXES))).alias("pos", "target"))
    found = tried.join(files.select(F.col("file").alias("target")).distinct(), "target")
    return found.groupBy("file", "module").agg(F.min_by("target", "pos").alias("target"))


def imported(refs: DataFrame, module_of: DataFrame, entities: DataFrame) -> DataFrame:
    """(file, name, target, confidence): names that exactly one of the files a file imports defines, 0.85.
    module_of: (file, target), as of module_files."""
    defs = entities.where(F.col("kind").isin(CALLABLE)).select(F.col("file").alias("target"), "name").distinct()
    names = refs.where("kind = 'call'").select("file", "name").distinct()
    hits = names.join(module_of.select("file", "target").distinct(), "file").join(defs, ["target", "name"])
    return hits.groupBy("file", "name").agg(F.count("*").alias("k"), F.min("target").alias("target")).where("k = 1").select("file", "name", "target", F.lit(0.85).alias("confidence"))


def member_calls(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(file, caller, name, target, how, confidence) of calls receiver.method, by the first rule that finds one:

    self or this: the caller's class in this file (0.95); a class of this file with the receiver's name (0.9); the only
    class of that name that has the method (0.8); the only file with the receiver's name as stem that defines it (0.7)."""
    calls = refs.where((F.col("kind") == "call") & F.col("name").rlike(r"^[A-Za-z_]\w*\.\w+$")).select("file", "caller", "name").distinct()
    parts = F.split("name", r"\.")
    calls = calls.withColumn("recv", parts[0]).withColumn("method", parts[1]).withColumn("own", F.when(F.col("recv").isin("self", "this"), F.regexp_extract("caller", r"([^.:]+)(?:\.|::)[^.:]+$", 1)))
    cls = tail_segment(F.col("parent"))
    methods = entities.where("parent is not null").select(F.col("file").alias("target"), cls.alias("cls"), F.col("name").alias("method")).distinct()
    local = methods.select(F.col("target").alias("file"), "cls", "method", F.lit(True).alias("here"))
    one_class = methods.groupBy("cls", "method").agg(F.count("*").alias("k"), F.min("target").alias("by_class")).where("k = 1").drop("k")
    stem = F.regexp_extract("file", r"([^/.]+)(?:\.[^/]*)?$", 1)
    by_file = entities.where("parent is null").select(stem.alias("recv"), F.col("name").alias("method"), "file").distinct()
    one_file = by_file.groupBy("recv", "method").agg(F.count("*").alias("k"), F.min("file").alias("by_stem")).where("k = 1").drop("k")
    out = calls.withColumn("cls", F.coalesce("own", "recv")).join(local, ["file", "cls", "method"], "left").join(one_class, ["cls", "method"], "left").join(one_file, ["recv", "method"], "left")
    own = F.col("own").isNotNull()
    to = lambda target, how, sure: F.struct(target.alias("target"), F.lit(how).alias("how"), F.lit(sure).alias("confidence"))
    rule = (
        F.when(F.col("here") & own, to(F.col("file"), "self", 0.95))
        .when(F.col("here"), to(F.col("file"), "class", 0.9))
        .when(~own & F.col("by_class").isNotNull(), to(F.col("by_class"), "unique_class", 0.8))
        .when(~own & F.col("by_stem").isNotNull(), to(F.col("by_stem"), "module", 0.7))
    )
    return out.withColumn("r", rule).where("r is not null").select("file", "caller", "name", "r.*")


def through_barrels(calls: DataFrame, imports: DataFrame, entities: DataFrame, rounds: int = 8) -> DataFrame:
    """(file, name, target, confidence): names that a file imports from one that only imports them in turn, followed to
    the file that defines them, 0.7. calls(file, name); imports(file, name, origin). Cycles end after ``rounds``."""
    defs = entities.select(F.col("file").alias("at"), "name").distinct()
    again = imports.select(F.col("file").alias("at"), "name", "origin").distinct()
    at = calls.select("file", "name").distinct().join(imports.select("file", "name", F.col("origin").alias("at")).distinct(), ["file", "name"])
    at = at.join(defs, ["at", "name"], "left_anti")  # a direct import needs no following
    found = None
    for _ in range(rounds):
        at = at.join(again, ["at", "name"]).select("file", "name", F.col("origin").alias("at")).distinct()
        hit = at.join(defs, ["at", "name"], "left_semi")
        found = hit if found is None else found.unionByName(hit)
        at = at.join(defs, ["at", "name"], "left_anti")
    return found.groupBy("file", "name").agg(F.min("at").alias("target")).withColumn("confidence", F.lit(0.7))


def by_manifest(imports: DataFrame, prefixes: DataFrame, files: DataFrame, sep: str = "/") -> DataFrame:
    """(file, module, target, confidence): imports under a manifest's prefix (longest first, cut at sep) to the file or
    the only file of the directory that the rest names, 0.7. prefixes(prefix, dir): go.mod modules, PSR-4 namespaces,
    workspace crates, source roots of a JVM build, Swift targets, C# root namespaces."""
    parts = F.split("module", "\\Q" + sep + "\\E")
    own = imports.select("file", "module").distinct().withColumn("p", parts).select("file", "module", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    own = own.withColumn("prefix", F.array_join(F.slice("p", F.lit(1), F.col("n")), sep))
    best = own.join(prefixes.select("prefix", "dir"), "prefix").groupBy("file", "module", "p").agg(F.max(F.struct("n", "dir")).alias("b"))
    path = normal_path(F.concat_ws("/", "b.dir", F.array_join(F.slice("p", F.col("b.n") + 1, F.size("p")), "/")))
    want = best.select("file", "module", path.alias("path"))
    name = F.regexp_replace("file", r"\.[^./]+$", "")
    as_file = files.select(name.alias("path"), F.col("file").alias("target"), F.lit(0).alias("o"))
    as_dir = files.select(F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("path"), F.col("file").alias("target"), F.lit(1).alias("o"))
    hits = want.join(as_file.unionByName(as_dir), "path").where("target != file").groupBy("file", "module", "o").agg(F.count_distinct("target").alias("k"), F.min("target").alias("target")).where("k = 1")
    return hits.groupBy("file", "module").agg(F.min_by("target", "o").alias("target")).withColumn("confidence", F.lit(0.7))


def overrides(entities: DataFrame, most: int = 5) -> DataFrame:
    """(name, parent, file, other_parent, other_file): definitions with the same last segment in other classes, the first ``most`` by file and parent."""
    e = entities.where("parent is not null").select(tail_segment(F.col("name")).alias("name"), "parent", "file").distinct()
    o = e.select("name", F.col("parent").alias("other_parent"), F.col("file").alias("other_file"))
    # of a row's first ``most`` every class is among the first most + 1 of the name, and gives its first ``most`` files
    w = Window.partitionBy("name", "other_parent").orderBy("other_file")
    few = o.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most).withColumn("least", F.min("other_file").over(w))
    firsts = few.withColumn("k", F.dense_rank().over(Window.partitionBy("name").orderBy("least", "other_parent"))).where(F.col("k") <= most + 1).select("name", "other_parent", "other_file")
    hits = e.join(firsts, "name").where("parent != other_parent")
    rank = F.row_number().over(Window.partitionBy("name", "parent", "file").orderBy("other_file", "other_parent"))
    return hits.withColumn("r", rank).where(F.col("r") <= most).select("name", "parent", "file", "other_parent", "other_file")


def cross_repo_symbols(sentinels: DataFrame, providers: DataFrame, canonical: DataFrame, most: int = 10) -> DataFrame:
    """(repo, name, provider_repo, provider_file, confidence): external names (repo, name) and the repositories that
    define their last segment, where the name starts with one of the provider's canonical names (repo, canonical).

    Test files provide nothing; of one name's candidates the first ``most`` stay; 0.9 for the only one, else 0.6.
    providers: (repo, file, name)."""
    n = F.regexp_replace("name", r"::|\.", "/")
    s = sentinels.select("repo", "name").distinct().withColumn("leaf", F.coalesce(bare_leaf(F.col("name")), F.regexp_extract("name", "([^/]*)$", 1)))
    parts = F.split(n, "/")
    s = s.withColumn("canonical", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    p = providers.where(~is_test_path(F.col("file"))).select(F.col("repo").alias("provider_repo"), F.col("file").alias("provider_file"), tail_segment(F.col("name")).alias("leaf")).distinct()
    c = canonical.select(F.col("repo").alias("provider_repo"), F.regexp_replace("canonical", r"::|\.", "/").alias("canonical")).distinct()
    hits = s.join(c, "canonical").join(p, ["provider_repo", "leaf"]).where("repo != provider_repo").select("repo", "name", "provider_repo", "provider_file").distinct()
    w = Window.partitionBy("repo", "name")
    ranked = hits.withColumn("k", F.row_number().over(w.orderBy("provider_repo", "provider_file"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("k") <= most).select("repo", "name", "provider_repo", "provider_file", F.when(F.col("n") == 1, 0.9).otherwise(0.6).alias("confidence"))


def externals(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, file, target, confidence): external names whose whole or last segment is a definition's name or qualified name, 0.4."""
    w = wanted.select("name").distinct()
    keys = w.select("name", F.explode(F.array_distinct(F.array_compact(F.array(F.col("name"), bare_leaf(F.col("name")))))).alias("key"))
    defs = entities.select("file", F.col("name").alias("target"), F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified_name")))).alias("key"))
    return keys.join(defs, "key").select("name", "file", "target").distinct().withColumn("confidence", F.lit(0.4))


def rewritten(paths: DataFrame, rewrites: DataFrame) -> DataFrame:
    """paths(path, ...) with the path behind the proxy (target): its longest consumer_prefix, cut at slashes, replaced by
    the provider_prefix; null without one. rewrites: (consumer_prefix, provider_prefix), of one consumer_prefix the least counts."""
    parts = F.split(F.regexp_replace("path", "^/+", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    strip = lambda c: F.regexp_replace(c, "(.)/+$", "$1")
    r = rewrites.groupBy(strip(F.col("consumer_prefix")).alias("prefix")).agg(F.min("provider_prefix").alias("to"))
    own = paths.select("path").distinct().select("path", F.explode(prefixes).alias("prefix")).join(r, "prefix")
    best = own.groupBy("path").agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix", "to")).alias("b"))
    rest = F.expr("substring(path, if(b.prefix = '/', 0, length(b.prefix)) + 1)")
    target = F.regexp_replace(F.concat_ws("/", strip(F.col("b.to")), rest), "/{2,}", "/")
    return paths.join(best.select("path", F.when(target == "", "/").otherwise(strip(target)).alias("target")), "path", "left")


def upsert_kind(refs: DataFrame, fresh: DataFrame, kind: str) -> DataFrame:
    """refs with the rows of a kind replaced by fresh ones."""
    return refs.where(F.col("kind") != kind).unionByName(fresh, allowMissingColumns=True)


def workspace(members: dict[str, DataFrame], frame: str = "entities") -> DataFrame:
    """The members' frames as one, with a repo column: files (and resolved callee ids) get the member's name in front, except ``<external>`` ones."""
    out = None
    for name, df in sorted(members.items()):
        each = df.withColumn("repo", F.lit(name))
        for c in ("file", *(["callee_id"] if frame == "refs" and "callee_id" in df.columns else [])):
            outside = F.col(c).startswith("<external>") | F.col(c).startswith("external:")
            each = each.withColumn(c, F.when(outside, F.col(c)).otherwise(F.concat(F.lit(name + "/"), c)))
        out = each if out is None else out.unionByName(each, allowMissingColumns=True)
    return out
