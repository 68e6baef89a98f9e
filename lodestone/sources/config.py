"""Sources: files of a tree, JSON lines of entities and refs, JSON objects, Markdown, Python, HTML script blocks."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line_start", T.LongType()),
    T.StructField("line_end", T.LongType()), T.StructField("parent", T.StringType()), T.StructField("qualified_name", T.StringType()), T.StructField("sig", T.StringType()),
    T.StructField("body_hash", T.StringType()), T.StructField("sig_hash", T.StringType()), T.StructField("visibility", T.StringType()), T.StructField("doc", T.StringType()),
    T.StructField("heritage", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("target", T.StringType())]))),
])
REF = T.StructType([T.StructField("file", T.StringType()), T.StructField("caller", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.LongType()), T.StructField("confidence", T.DoubleType())])

#: Directories that hold no source. Fixed values.
SKIPPED = [".git", "node_modules", "target", "dist", "build", "vendor", "__pycache__", ".venv"]


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """(file, text): the files of a tree with these extensions; hidden and skipped directories are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.concat(F.lit("/"), F.substring_index("path", root.rstrip("/") + "/", -1))
    skipped = "|".join(d.replace(".", "\\.") for d in SKIPPED)
    kept = found.where(~inside.rlike(f"/(?:{skipped}|\\.[^/]+)/") & inside.rlike(r"\.(?:" + "|".join(extensions) + ")$"))
    return kept.select(F.substring(inside, 2, 1 << 20).alias("file"), F.decode("content", "UTF-8").alias("text"))


def changed_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose hash isn't in cache(file, hash); the others' rows can be used again."""
    hashed = files.withColumn("hash", F.sha2("text", 256))
    return hashed.join(cache.select("file", "hash"), ["file", "hash"], "left_anti")


def read_entities(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return spark.read.schema(ENTITY).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_refs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """References; the kind may be written ref_kind."""
    schema = T.StructType([*REF.fields, T.StructField("ref_kind", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows.withColumn("kind", F.coalesce("kind", "ref_kind")).drop("ref_kind")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in a fixed order, without null fields."""
    df.repartitionByRange("file").sortWithinPartitions(*[c for c in ("file", "line_start", "line", "name") if c in df.columns]).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def json_keys(rows: DataFrame, column: str) -> DataFrame:
    """(key, n): the keys of JSON objects and how many have each."""
    return rows.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def script_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, blocks): how many script elements a page opens."""
    return pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit("(?is)(<script[^>]*>)"), F.lit(1))).alias("blocks"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """(file, name, level, line): ATX headings outside fences."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    from pyspark.sql import Window

    fence = F.sum(F.when(F.col("l").rlike(r"^\s*(?:```|~~~)"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("pos"))
    heads = lines.withColumn("inside", fence % 2).where(F.col("l").rlike(r"^#{1,6}\s+\S") & (F.col("inside") == 0))
    return heads.select("file", F.left(F.trim(F.regexp_replace("l", r"^#+\s+|\s+#*\s*$", "")), F.lit(60)).alias("name"), F.length(F.regexp_extract("l", "^(#+)", 1)).alias("level"), (F.col("pos") + 1).cast("long").alias("line"))


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def python_rows(file: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Entities and references of a Python file; nothing for one that doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    lines = text.split("\n")
    entities: list[tuple] = []
    refs: list[tuple] = []

    def walk(node: ast.AST, scope: list[str], in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            parent = ".".join(scope) or None
            inner, nested = scope, in_class
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                body = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                sig = lines[child.lineno - 1].strip().rstrip(":")
                bases = [("extend", ast.unparse(b)) for b in child.bases] if is_class else []
                kind = "class" if is_class else "method" if in_class else "function"
                entities.append((file, child.name, kind, child.lineno, child.end_lineno, parent, ".".join([*scope, child.name]), sig, _h(body), _h(sig), "private" if child.name.startswith("_") else "public", ast.get_docstring(child), bases))
                inner, nested = [*scope, child.name], is_class
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                base = getattr(child, "module", None)
                for a in child.names:
                    refs.append((file, parent, f"{base}.{a.name}" if base else a.name, "import", child.lineno, None))
            elif isinstance(child, ast.Call):
                refs.append((file, parent, ast.unparse(child.func), "call", child.lineno, None))
            walk(child, inner, nested)

    walk(tree, [], False)
    return entities, refs


def parse_python(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and refs of files(file, text)."""

    def part(which: int, columns: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [r for f, t in zip(pdf["file"], pdf["text"]) for r in python_rows(f, t or "")[which]]
                yield pd.DataFrame(rows, columns=columns)

        return run

    plain = files.select("file", "text")
    return plain.mapInPandas(part(0, ENTITY.names), ENTITY), plain.mapInPandas(part(1, REF.names), REF)
