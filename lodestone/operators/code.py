"""Point queries, catalogue, clones, dead code and resolution over entities and refs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.names import alias_keys, bare_leaf, caller_keys, is_exported, language, parent_dir, short_hash, tail_segment

TOP_LEVEL = ["function", "class", "struct", "enum", "trait", "interface", "type", "module", "const", "impl", "macro"]


def limited(df: DataFrame, limit: int) -> DataFrame:
    """0 is no limit."""
    return df.limit(limit) if limit else df


def callers(refs: DataFrame, name: str) -> DataFrame:
    """References that are found under a name. Every key is a part of the reference's name, so a substring test, which
    the scan can take, comes before the keys are made."""
    return refs.where(F.contains("name", F.lit(name))).where(F.array_contains(alias_keys(F.col("name")), name))


def callees(refs: DataFrame, caller: str) -> DataFrame:
    """References made by a caller, a prefix of one, or its leaf."""
    last = caller.replace("::", ".").split(".")[-1]  # prefixes are written with dots, so only a segment is sure to be a part
    return refs.where(F.contains("caller", F.lit(last))).where(F.array_contains(caller_keys(F.col("caller")), caller))


def grouped(refs: DataFrame, by: str) -> DataFrame:
    """References counted by file, caller, name or kind."""
    if by not in ("file", "caller", "name", "kind"):
        raise ValueError(f"unknown dimension {by}")
    return refs.groupBy(F.coalesce(F.col(by), F.lit("<top-level>")).alias(by)).agg(F.count("*").alias("n"))


def file_symbols(entities: DataFrame, file: str, kind: str | None = None, parent: str | None = None, limit: int = 0) -> DataFrame:
    found = entities.where(F.col("file") == file)
    if kind:
        found = found.where(F.col("kind") == kind)
    if parent:
        found = found.where(F.col("parent") == parent)
    return limited(found.orderBy("line_start", "name"), limit)


def search(entities: DataFrame, text: str, kind: str | None = None, prefix: str | None = None, limit: int = 0) -> DataFrame:
    """(section, file, name, kind, line, n): symbols whose name contains the text, whatever its case, then files whose path does, with their number of entities."""
    if not text:
        return entities.select(F.lit("symbol").alias("section"), "file", "name", "kind", F.col("line_start").alias("line"), F.lit(1).cast("long").alias("n")).limit(0)
    pool = entities.where(F.startswith("file", F.lit(prefix))) if prefix else entities
    named = pool.where(F.contains(F.lower("name"), F.lit(text.lower())))
    if kind:
        named = named.where(F.col("kind") == kind)
    symbols = named.select(F.lit("symbol").alias("section"), "file", "name", "kind", F.col("line_start").alias("line"), F.lit(1).cast("long").alias("n"))
    files = pool.where(F.contains(F.lower("file"), F.lit(text.lower()))).groupBy("file").agg(F.count("*").alias("n"))
    files = files.select(F.lit("file").alias("section"), "file", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("line"), "n")
    return limited(symbols.unionByName(files).orderBy(F.col("section").desc(), "file", "line", "name"), limit)


def overloads(found: DataFrame, *by: str) -> DataFrame:
    """Definitions alike in ``by`` as one: the first line and how many there are."""
    return found.groupBy(*by).agg(F.min("line_start").alias("line"), F.count("*").alias("overloads"))


def where_defined(entities: DataFrame, name: str) -> DataFrame:
    """Definitions whose last segment is the name, overloads as one."""
    return overloads(entities.where(tail_segment(F.col("name")) == name), "file", "parent", "kind")


def outline(entities: DataFrame) -> DataFrame:
    """(file, n, symbols): the top-level symbols of every file in order."""
    top = entities.where(F.col("parent").isNull() & F.col("kind").isin(TOP_LEVEL))
    listed = F.array_sort(F.collect_list(F.struct("line_start", "name", "kind")))
    return top.groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["line_start"].cast("string"), s["kind"], s["name"])), ",").alias("symbols"))


def did_you_mean(entities: DataFrame, name: str, k: int = 5) -> DataFrame:
    """(name, distance): the k names nearest by edits, at most half the length away (2 at least)."""
    most = max(2, len(name) // 2)
    near = entities.select("name").distinct().withColumn("distance", F.levenshtein("name", F.lit(name), most))
    return near.where(F.col("distance").between(0, most)).orderBy("distance", "name").limit(k)


def directories(entities: DataFrame) -> DataFrame:
    """(dir, files, languages)"""
    f = entities.select("file").distinct().select(parent_dir(F.col("file")).alias("dir"), "file", language(F.col("file")).alias("lang"))
    return f.groupBy("dir").agg(F.count("*").alias("files"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"))


def files_capped(entities: DataFrame, cap: int) -> DataFrame:
    """(dir, file): the first ``cap`` files of every directory."""
    f = entities.select(parent_dir(F.col("file")).alias("dir"), "file").distinct()
    return f.withColumn("n", F.row_number().over(Window.partitionBy("dir").orderBy("file"))).where(F.col("n") <= cap).drop("n")


def clones(entities: DataFrame, key: str = "body_hash", min_lines: int = 3, most: int | None = None) -> DataFrame:
    """(key, n, lines, first): definitions with the same body, of ``min_lines`` lines at least."""
    real = entities.where(~F.col("kind").isin("import", "use", "package") & (F.col("line_end") - F.col("line_start") + 1 >= min_lines) & F.col(key).isNotNull())
    groups = real.groupBy(key).agg(F.count("*").alias("n"), F.max(F.col("line_end") - F.col("line_start") + 1).alias("lines"), F.min(F.struct("file", "line_start")).alias("m"))
    groups = groups.where((F.col("n") > 1) & (F.col("n") <= most if most else F.lit(True)))
    return groups.select(key, "n", "lines", F.concat_ws(":", "m.file", F.col("m.line_start").cast("string")).alias("first"))


def unreferenced(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """Definitions that no reference names, by name or qualified name."""
    used = refs.select("name").distinct().select(F.explode(alias_keys(F.col("name"))).alias("key")).distinct()
    left = entities.where(F.col("kind") != "import").join(used, F.col("name") == F.col("key"), "left_anti")
    return left.join(used, F.col("qualified_name") == F.col("key"), "left_anti")


def unreferenced_files(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """(file, confidence): files none of whose definitions any reference names, sure at 1."""
    used = refs.select("name").distinct().select(F.explode(alias_keys(F.col("name"))).alias("key")).distinct()
    named = entities.select("file", F.explode(F.array_compact(F.array("name", "qualified_name"))).alias("key")).join(used, "key", "left_semi")
    return entities.select("file").distinct().join(named.select("file").distinct(), "file", "left_anti").withColumn("confidence", F.lit(1.0))


#: Ends of names that are looked up at run time. Fixed values.
DYNAMIC = ["Plugin", "Handler", "Adapter", "Middleware", "Provider", "Factory", "Service"]


def dead_code(entities: DataFrame, refs: DataFrame, entry_files: DataFrame | None = None, least: float = 0.7) -> DataFrame:
    """(file, name, kind, confidence): 0.85 for exported definitions without reference, 0.7 for internal ones, 0.5 where a
    name looks dynamically found (more than one of DYNAMIC alone); files that a framework calls (entry_files) are left
    out. Visibility decides what is exported; where it is missing, the language's convention."""
    dead = unreferenced(entities, refs)
    if entry_files is not None:
        dead = dead.join(entry_files.select("file"), "file", "left_anti")
    dynamic = tail_segment(F.col("name")).rlike(".(?:" + "|".join(DYNAMIC) + ")$")
    exported = is_exported(F.col("name"), F.col("visibility") if "visibility" in dead.columns else F.lit(None).cast("string"), F.col("file"))
    confidence = F.when(dynamic, 0.5).when(exported, 0.85).otherwise(0.7)
    return dead.select("file", "name", "kind", confidence.alias("confidence")).where(F.col("confidence") >= least)


def enclosing(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """hits(file, line, ...) with the innermost definition around each: the one that starts last, null without any.

    Lines are cut into cells of 2^k lines, k from 0. A definition is put on the few cells that make it up, two of a size at
    most, and a cell keeps the best of its own; a hit meets the one cell of each size that it lies in, by equality. Both
    joins merge: Spark takes cells and hits for as small as their files are, and would send all of them to the driver."""
    best = F.struct(F.col("line_start"), -F.col("line_end"), F.col("name"))
    spans = entities.where("kind != 'module' and line_start <= line_end")
    # a greatest long may stand for the end of a file; there are no lines beyond 2^62
    spans = spans.select(F.col("file").alias("_f"), F.col("line_start").cast("long").alias("_l"), (F.least(F.col("line_end").cast("long"), F.lit(1 << 62)) + 1).alias("_r"), best.alias("_s"))
    sized = spans.select("*", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("_r") - F.col("_l"))) - 1)).alias("_k"))
    # whole cells from the first that begins in the definition to the last that ends in it: at its ends those that no larger cell holds
    first, end = -F.call_function("shiftright", -F.col("_l"), F.col("_k")), F.call_function("shiftright", F.col("_r"), F.col("_k"))
    cells = sized.select("_f", "_k", "_s", first.alias("_a"), end.alias("_b")).where("_a < _b")
    at = F.array_compact(F.array(F.when(F.col("_a") % 2 != 0, F.col("_a")), F.when(F.col("_b") % 2 != 0, F.col("_b") - 1)))
    held = cells.select("_f", "_k", F.explode(at).alias("_c"), "_s").groupBy("_f", "_k", "_c").agg(F.max("_s").alias("_s"))
    sizes = spans.agg(F.max(F.length(F.bin(F.col("_r") - F.col("_l")))).alias("_n"))  # one row
    places = hits.select("file", F.col("line").cast("long").alias("line")).distinct().crossJoin(F.broadcast(sizes))
    each = places.select("file", "line", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k")).withColumn("_c", F.call_function("shiftright", F.col("line"), F.col("_k")))
    found = each.join(held.hint("merge"), (F.col("file") == F.col("_f")) & (each["_k"] == held["_k"]) & (each["_c"] == held["_c"]))
    inner = found.groupBy(F.col("file").alias("_f"), F.col("line").alias("_l")).agg(F.max("_s").alias("_s"))
    return hits.join(inner.hint("merge"), (F.col("file") == F.col("_f")) & (F.col("line") == F.col("_l")), "left").select(*hits.columns, F.col("_s.name").alias("entity"))


def nearest_before(points: DataFrame, spans: DataFrame, gap: int = 2) -> DataFrame:
    """points(file, line) with the span (file, name, line_end) that ends nearest before, at most ``gap`` lines away: an as-of join.

    The gap is small, so a point meets only the ends in reach by equality."""
    near = points.select("*", F.explode(F.sequence(F.col("line") - gap, F.col("line") - 1)).alias("_end"))
    ends = spans.select(F.col("file").alias("_f"), F.col("line_end").alias("_e"), F.col("name").alias("doc"))
    found = near.join(ends, (F.col("file") == F.col("_f")) & (F.col("_end") == F.col("_e")))
    best = found.groupBy(*points.columns).agg(F.max(F.struct("_end", "doc")).alias("b"))
    return best.select(*points.columns, F.col("b.doc").alias("doc"), F.col("b._end").alias("doc_end"))


def unique_global(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, n, confidence): reference names with exactly one definition among all files, confidence 0.5."""
    one = entities.groupBy("name").agg(F.count("*").alias("defs"), F.min("file").alias("target")).where("defs = 1")
    return refs.where("kind = 'call'").groupBy("name").agg(F.count("*").alias("n")).join(one, "name").select("name", "n", "target", F.lit(0.5).alias("confidence"))


def cascade(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, confidence): same file 0.95, then a unique definition of the name 0.5, then of its leaf 0.4, else 0."""
    here = entities.select(F.col("file").alias("_f"), F.col("name").alias("_n")).distinct()
    unique = entities.groupBy("name").agg(F.count("*").alias("c")).where("c = 1")
    each = refs.select("file", "name").distinct().withColumn("leaf", bare_leaf(F.col("name")))
    out = each.join(here, (F.col("file") == F.col("_f")) & (F.col("name") == F.col("_n")), "left").join(unique.select(F.col("name").alias("_u")), F.col("name") == F.col("_u"), "left")
    out = out.join(unique.select(F.col("name").alias("_l")), F.col("leaf") == F.col("_l"), "left")
    return out.select("file", "name", F.when(F.col("_f").isNotNull(), 0.95).when(F.col("_u").isNotNull(), 0.5).when(F.col("_l").isNotNull(), 0.4).otherwise(0.0).alias("confidence"))


def longest_prefix(paths: DataFrame, prefixes: DataFrame, sep: str = "/") -> DataFrame:
    """paths(path) with the longest of prefixes(prefix) that it starts with, at a separator: by equality with each of the path's own prefixes."""
    parts = F.split("path", sep)
    own = paths.distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))).alias("prefix"))
    best = own.join(prefixes.select("prefix").distinct(), "prefix").groupBy("path").agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix")).alias("b"))
    return best.select("path", F.col("b.prefix").alias("prefix"))


def external_sentinels(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """(name): imported names that no file defines, each once."""
    return imports.select("name").distinct().join(entities.select("name").distinct(), "name", "left_anti").select(F.concat(F.lit("external:"), "name").alias("name"))


def heritage(edges: DataFrame, symbol: str) -> DataFrame:
    """Of edges(child, kind, target): those into the symbol, by target or its last segment."""
    return edges.where(F.array_contains(F.array_compact(F.array("target", F.regexp_extract("target", r"([^./]*)$", 1))), symbol))


def map_files(scored: DataFrame, depth: int) -> DataFrame:
    """The ``depth`` entities of most score of each file: scored(file, name, score)."""
    return scored.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.col("score").desc(), "name"))).where(F.col("n") <= depth)


def budget_prefix(files: DataFrame, budget: int, start: int = 100) -> DataFrame:
    """files(file, score, tokens) from the best down as long as they fit, one at least: a report's budget is one running sum."""
    w = Window.orderBy(F.col("score").desc(), "file").rowsBetween(Window.unboundedPreceding, 0)
    run = files.withColumn("total", F.lit(start) + F.sum("tokens").over(w)).withColumn("n", F.count("*").over(w))
    return run.where((F.col("total") <= budget) | (F.col("n") == 1)).select("file", "score", "tokens", "total")


def hashes(texts: DataFrame, column: str = "text") -> DataFrame:
    """(key, n): texts with equal normal form (spaces collapsed, lower case) and their number."""
    normal = F.lower(F.trim(F.regexp_replace(column, "[ \\t]+", " ")))
    return texts.groupBy(short_hash(normal).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def classify(matched: DataFrame, public: Column | None = None) -> DataFrame:
    """matched(old, new structs; how): added, removed, renamed, moved, modified or formatting, and whether that breaks callers."""
    is_public = F.col("old.parent").isNull() if public is None else public
    sig = F.col("old.sig_hash") != F.col("new.sig_hash")
    body = F.col("old.body_hash") != F.col("new.body_hash")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("how") == "renamed", "renamed").when(F.col("how") == "moved", "moved").when(~sig & ~body, "formatting").otherwise("modified")
    out = matched.withColumn("change", change)
    breaking = F.when(F.col("change").isin("removed", "renamed"), is_public).when(F.col("change").isin("moved", "modified"), is_public & sig).otherwise(F.lit(False))
    return out.withColumn("breaking", F.coalesce(breaking, F.lit(False)))


def match_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new, how): definitions of two snapshots, matched by (file, parent, name), then (parent, name), then body.

    Each side's rows are numbered within a key, so that a match takes one row of each; what is equal in all is dropped.
    Columns: file, parent, name, body_hash, sig_hash."""

    def side(df: DataFrame, name: str) -> DataFrame:
        cols = ["file", "parent", "name", "body_hash", "sig_hash"]
        return df.select(F.struct(*cols).alias(name), F.monotonically_increasing_id().alias(f"{name}_id"))

    a, b = side(old, "old"), side(new, "new")
    steps = [("exact", ["file", "parent", "name"]), ("moved", ["parent", "name"]), ("renamed", ["body_hash"])]
    matched = None
    for how, keys in steps:

        def numbered(df: DataFrame, s: str, keys=keys) -> DataFrame:
            out = df.select("*", *(F.col(f"{s}.{k}").alias(f"k{i}") for i, k in enumerate(keys)))
            if keys == ["body_hash"]:
                out = out.where("k0 is not null")
            return out.withColumn("n", F.row_number().over(Window.partitionBy(*(f"k{i}" for i in range(len(keys)))).orderBy(f"{s}.file", f"{s}.name", f"{s}.sig_hash", f"{s}.body_hash")))

        l, r = numbered(a, "old").alias("l"), numbered(b, "new").alias("r")  # noqa: E741
        on = " and ".join([f"l.k{i} <=> r.k{i}" for i in range(len(keys))] + ["l.n = r.n"])
        hit = l.join(r, F.expr(on)).select("old", "new", F.lit(how).alias("how"))
        matched = hit if matched is None else matched.unionByName(hit)
        a = l.join(r, F.expr(on), "left_anti").select("old", "old_id")
        b = r.join(l, F.expr(on), "left_anti").select("new", "new_id")
    null_old, null_new = F.lit(None).cast(a.schema["old"].dataType), F.lit(None).cast(a.schema["old"].dataType)
    rest = a.select("old", null_new.alias("new"), F.lit("removed").alias("how")).unionByName(b.select(null_old.alias("old"), "new", F.lit("added").alias("how")))
    same = (F.col("how") == "exact") & F.col("old.body_hash").eqNullSafe(F.col("new.body_hash")) & F.col("old.sig_hash").eqNullSafe(F.col("new.sig_hash"))
    return matched.unionByName(rest).where(~F.coalesce(same, F.lit(False)))
