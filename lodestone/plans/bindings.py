"""The star-schema tables seen as a code base: definitions, references, commits, lines.

The operators work on four frames (see lodestone.schema). These adapters make them from the driver's tables, so that
every operator runs at the tables' scale and has a SQL twin over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are definitions: file = brand, parent = type, kind by size, two lines a unit of size."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit(".py")).alias("file"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 10 == 0, "class").when(F.col("p_size") % 2 == 0, "function").otherwise("method").alias("kind"),
        F.when(F.col("p_size") % 2 == 1, F.col("p_type")).alias("parent"),
        F.col("p_partkey").alias("line_start"),
        (F.col("p_partkey") + F.col("p_size")).alias("line_end"),
        F.concat_ws("::", "p_type", "p_name").alias("qualified_name"),
        F.md5(F.concat_ws("|", "p_name", F.col("p_size").cast("string"))).alias("body_hash"),
    )


ENTITIES_SQL = """entities AS (
  SELECT 'src/' || lower(replace(p_brand, '#', '_')) || '.py' AS file, p_name AS name,
         CASE WHEN p_size % 10 = 0 THEN 'class' WHEN p_size % 2 = 0 THEN 'function' ELSE 'method' END AS kind,
         CASE WHEN p_size % 2 = 1 THEN p_type END AS parent, p_partkey AS line_start, p_partkey + p_size AS line_end,
         p_type || '::' || p_name AS qualified_name, md5(p_name || '|' || CAST(p_size AS VARCHAR)) AS body_hash
  FROM part)"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines are references: an order's status and priority name the calling file, the customer calls, the part is called."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.concat(F.lit("src/"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "_")), F.lit("/"), F.lower("o_orderstatus"), F.lit(".py")).alias("file"),
        F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("Customer"), F.col("o_custkey") % 100, F.lit("::buy"))).alias("caller"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.col("p_type"), F.lit("::"), F.col("p_name"))).otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("l_returnflag") == "R", "import").otherwise("call").alias("kind"),
        F.col("l_linenumber").cast("long").alias("line"),
    )


REFS_SQL = """refs AS (
  SELECT 'src/' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g')) || '/' || lower(o_orderstatus) || '.py' AS file,
         CASE WHEN o_custkey % 7 <> 0 THEN 'Customer' || CAST(o_custkey % 100 AS VARCHAR) || '::buy' END AS caller,
         CASE WHEN l_linenumber % 2 = 0 THEN p_type || '::' || p_name ELSE p_name END AS name,
         CASE WHEN l_returnflag = 'R' THEN 'import' ELSE 'call' END AS kind, CAST(l_linenumber AS BIGINT) AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, author, ts, file): orders are commits of customers' nations, their parts are files."""
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("sha"), F.concat(F.lit("dev"), F.col("c_nationkey"), F.lit("@example.org")).alias("author"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.concat(F.lit("f"), F.col("l_partkey") % 400).alias("file"))


COMMITS_SQL = """commits AS (
  SELECT o_orderkey AS sha, 'dev' || CAST(c_nationkey AS VARCHAR) || '@example.org' AS author,
         CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, 'f' || CAST(l_partkey % 400 AS VARCHAR) AS file
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, text): the lines of documents, numbered from 1."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc"), F.col("doc_id")).alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("file", (F.col("pos") + 1).cast("long").alias("line"), "text")


LINES_SQL = """lines AS (
  SELECT 'doc' || CAST(doc_id AS VARCHAR) AS file, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS line, unnest(l) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"""
