"""The registered queries of the code operators, over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import Engine, cluster_summary
from lodestone.functions import names
from lodestone.operators import code, diff, graph, history, resolve, text
from lodestone.plans import bindings as B
from lodestone.sources import config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *, needs: tuple[str, ...] = ()):
    """Registers a query under its function's name. needs: bindings that its SQL starts with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            with_ = ",\n".join(getattr(B, f"{n.upper()}_SQL") for n in needs)
            body = sql.strip()
            if with_ and body.upper().startswith("WITH "):
                body = "WITH " + with_ + ",\n" + body[5:]
            elif with_:
                body = "WITH " + with_ + "\n" + body
            ORACLES[f.__name__] = body
        return f

    return add


@query("SELECT file, coalesce(caller, '<top-level>') AS caller, count(*) AS n FROM refs GROUP BY 1, 2", needs=("refs",))
def callers_grouped(spark, sf_dir):
    return B.refs(spark, sf_dir).groupBy("file", F.coalesce("caller", F.lit("<top-level>")).alias("caller")).agg(F.count("*").alias("n"))


@query("SELECT file, caller, name, kind, line FROM refs, (SELECT min(p_name) AS x FROM part) WHERE name = x OR ends_with(name, '::' || x)", needs=("refs",))
def callers_by_name(spark, sf_dir):
    return code.callers(B.refs(spark, sf_dir), B.table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0])


@query("SELECT kind, count(*) AS n FROM refs GROUP BY kind", needs=("refs",))
def refs_by_kind(spark, sf_dir):
    return code.grouped(B.refs(spark, sf_dir), "kind")


@query("SELECT file, caller, name, kind, line FROM refs WHERE caller = 'Customer7::buy'", needs=("refs",))
def callees_by_prefix(spark, sf_dir):
    return code.callees(B.refs(spark, sf_dir), "Customer7")


@query("SELECT file, name, kind, parent, line_start, line_end, qualified_name, body_hash FROM entities WHERE file = 'src/brand_12.py' AND kind = 'class'", needs=("entities",))
def file_symbols(spark, sf_dir):
    return code.file_symbols(B.entities(spark, sf_dir), "src/brand_12.py", "class")


@query("""SELECT 'symbol' AS section, file, name, kind, line_start AS line, CAST(1 AS BIGINT) AS n FROM entities WHERE contains(lower(name), 'red')
UNION ALL SELECT 'file', file, NULL, NULL, NULL, count(*) FROM entities WHERE contains(lower(file), 'red') GROUP BY file""", needs=("entities",))
def search_all(spark, sf_dir):
    return code.search(B.entities(spark, sf_dir), "RED")


@query("SELECT file, name, kind, min(line_start) AS line, count(*) AS overloads FROM entities WHERE contains(lower(name), 'a') GROUP BY file, name, kind", needs=("entities",))
def search_dedup(spark, sf_dir):
    return code.overloads(B.entities(spark, sf_dir).where(F.contains(F.lower("name"), F.lit("a"))), "file", "name", "kind")


@query("SELECT file, parent, kind, min(line_start) AS line, count(*) AS overloads FROM entities WHERE regexp_extract(name, '([^:.]*)$', 1) = (SELECT min(p_name) FROM part) GROUP BY ALL", needs=("entities",))
def where_definition(spark, sf_dir):
    name = B.table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0]
    return code.where_defined(B.entities(spark, sf_dir), name)


@query("""SELECT file, count(*) AS n, string_agg(concat_ws(':', CAST(line_start AS VARCHAR), kind, name), ',' ORDER BY line_start, name, kind) AS symbols
FROM entities WHERE parent IS NULL AND kind IN ('function', 'class') GROUP BY file""", needs=("entities",))
def outline(spark, sf_dir):
    return code.outline(B.entities(spark, sf_dir))


@query("SELECT dir, count(*) AS files, 'python' AS languages FROM (SELECT DISTINCT regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, file FROM entities) GROUP BY dir", needs=("entities",))
def dir_overview(spark, sf_dir):
    return code.directories(B.entities(spark, sf_dir))


@query("""SELECT dir, file FROM (SELECT dir, file, row_number() OVER (PARTITION BY dir ORDER BY file) AS n
FROM (SELECT DISTINCT regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, file FROM entities)) WHERE n <= 10""", needs=("entities",))
def files_capped(spark, sf_dir):
    return code.files_capped(B.entities(spark, sf_dir), 10)


@query("SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM refs) AS refs", needs=("entities", "refs"))
def table_counts(spark, sf_dir):
    e, r = (x.agg(F.count("*").alias(n)) for x, n in ((B.entities(spark, sf_dir), "entities"), (B.refs(spark, sf_dir), "refs")))
    return e.crossJoin(r)  # one row each


@query("SELECT kind, count(*) AS n, count(DISTINCT file) AS files FROM entities WHERE line_end - line_start > 10 GROUP BY kind HAVING count(*) > 1", needs=("entities",))
def sql_passthrough(spark, sf_dir):
    B.entities(spark, sf_dir).createOrReplaceTempView("entities")
    return spark.sql("SELECT kind, count(*) AS n, count(DISTINCT file) AS files FROM entities WHERE line_end - line_start > 10 GROUP BY kind HAVING count(*) > 1")


@query("""SELECT name, distance FROM (SELECT DISTINCT name, CAST(levenshtein(name, 'red blu') AS INTEGER) AS distance FROM entities) WHERE distance <= 3
ORDER BY distance, name LIMIT 5""", needs=("entities",))
def did_you_mean(spark, sf_dir):
    return code.did_you_mean(B.entities(spark, sf_dir), "red blu")


@query("""SELECT body_hash, count(*) AS n, max(line_end - line_start + 1) AS lines,
min_by(file || ':' || CAST(line_start AS VARCHAR), struct_pack(f := file, l := line_start)) AS first
FROM entities WHERE line_end - line_start + 1 >= 3 GROUP BY body_hash HAVING count(*) > 1""", needs=("entities",))
def duplicate_bodies(spark, sf_dir):
    return code.clones(B.entities(spark, sf_dir))


@query("""SELECT substr(sha256(lower(trim(regexp_replace(text, '[ \\t]+', ' ', 'g')))), 1, 16) AS key, count(*) AS n
FROM lines GROUP BY 1 HAVING count(*) > 1""", needs=("lines",))
def duplicate_lines(spark, sf_dir):
    return code.hashes(B.lines(spark, sf_dir))


COCHANGE_SQL = """WITH f AS (SELECT DISTINCT sha, file FROM commits), s AS (SELECT sha FROM f GROUP BY sha HAVING count(*) <= 30),
k AS (SELECT f.* FROM f JOIN s USING (sha)), n AS (SELECT file, count(*) AS n FROM k GROUP BY file),
p AS (SELECT x.file AS a, y.file AS b, count(*) AS support FROM k x JOIN k y ON x.sha = y.sha AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 2),
pairs AS (SELECT a, b, support, support / sqrt(na.n * nb.n) AS weight FROM p JOIN n na ON na.file = a JOIN n nb ON nb.file = b)
"""


@query(COCHANGE_SQL + "SELECT a, b, support, round(weight, 8) AS weight FROM pairs", needs=("commits",))
def cochange_pairs(spark, sf_dir):
    return history.cochange(B.commits(spark, sf_dir)).withColumn("weight", F.round("weight", 8))


@query(COCHANGE_SQL + """, both_ AS (SELECT a AS file, b AS partner, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs)
SELECT file, partner, round(weight, 8) AS weight, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(weight, 8) DESC, partner) AS rank FROM both_) WHERE rank <= 3""", needs=("commits",))
def cochange_partners_topk(spark, sf_dir):
    return history.partners(cochange_pairs(spark, sf_dir))


@query(COCHANGE_SQL + """, w AS (SELECT a, b, round(weight, 8) AS weight FROM pairs), t AS (SELECT DISTINCT file FROM commits WHERE sha = (SELECT max(sha) FROM commits)),
both_ AS (SELECT a AS file, b AS partner, weight FROM w UNION ALL SELECT b, a, weight FROM w),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY weight DESC, partner) AS rank FROM both_) WHERE rank <= 3 AND weight >= 0.01)
SELECT least(file, partner) AS a, greatest(file, partner) AS b, max(weight) AS weight FROM top
WHERE file IN (SELECT file FROM t) AND partner NOT IN (SELECT file FROM t) GROUP BY 1, 2""", needs=("commits",))
def cochange_misses(spark, sf_dir):
    """What goes with the files of the last commit and isn't in it."""
    c = B.commits(spark, sf_dir)
    last = c.agg(F.max("sha")).first()[0]
    return history.cochange_misses(cochange_pairs(spark, sf_dir), c.where(F.col("sha") == last), least=0.01)


@query("""WITH c AS (SELECT file, count(DISTINCT sha) AS churn FROM commits GROUP BY file),
s AS (SELECT 'f' || CAST(p_partkey % 400 AS VARCHAR) AS file, sum(p_size) AS lines FROM part GROUP BY 1)
SELECT file, churn, CAST(lines AS BIGINT) AS lines, CAST(churn * lines AS BIGINT) AS score FROM c JOIN s USING (file)""", needs=("commits",))
def hotspots(spark, sf_dir):
    sizes = B.table(spark, sf_dir, "part").groupBy(F.concat(F.lit("f"), F.col("p_partkey") % 400).alias("file")).agg(F.sum("p_size").alias("lines"))
    return history.hotspots(B.commits(spark, sf_dir), sizes)


BY_AUTHOR_SQL = "WITH n AS (SELECT file, author, count(DISTINCT sha) AS n FROM commits GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, author) AS k FROM n)\n"


@query(BY_AUTHOR_SQL + """SELECT file, max(CASE WHEN k = 1 THEN author END) AS owner, round(100.0 * max(n) / sum(n), 8) AS percent, count(*) AS authors, CAST(sum(n) AS BIGINT) AS commits
FROM r GROUP BY file""", needs=("commits",))
def ownership(spark, sf_dir):
    return history.ownership(B.commits(spark, sf_dir)).withColumn("percent", F.round("percent", 8))


@query(BY_AUTHOR_SQL + """, s AS (SELECT file, max(CASE WHEN k = 1 THEN n END) / sum(n) AS top, coalesce(max(CASE WHEN k = 2 THEN n END), 0) / sum(n) AS second FROM r GROUP BY file)
SELECT file, round(top, 8) AS top, round(second, 8) AS second, CASE WHEN top >= 0.8 THEN 'high' WHEN top + second >= 0.8 THEN 'medium' ELSE 'low' END AS risk FROM s""", needs=("commits",))
def bus_factor(spark, sf_dir):
    out = history.bus_factor(B.commits(spark, sf_dir))
    return out.withColumn("top", F.round("top", 8)).withColumn("second", F.round("second", 8))


@query("""WITH e AS (SELECT event_type AS repo, 'u' || CAST(user_id AS VARCHAR) AS file, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events),
p AS (SELECT least(a.repo, b.repo) AS source_repo, CASE WHEN a.repo < b.repo THEN a.file ELSE b.file END AS source_file, greatest(a.repo, b.repo) AS target_repo,
      CASE WHEN a.repo < b.repo THEN b.file ELSE a.file END AS target_file, b.ts AS ts
      FROM e a JOIN e b ON b.ts - a.ts BETWEEN 0 AND 3600 AND a.repo <> b.repo AND (a.ts < b.ts OR a.repo < b.repo))
SELECT source_repo, source_file, target_repo, target_file, round(sum(exp(-(((SELECT max(ts) FROM e) - ts) / 86400.0) / 180.0)), 6) AS strength, count(*) AS frequency,
       max(ts) AS last_unix, strftime(to_timestamp(max(ts)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS last_date
FROM p GROUP BY 1, 2, 3, 4""")
def cross_source_cochange(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("repo"), F.concat(F.lit("u"), "user_id").alias("file"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    return history.cross_repo_cochange(e, 3600, most=None, digits=6)


def _nth(options: list[str], n: Column) -> Column:
    """The option with this number, from 0, modulo how many there are."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(n, F.lit(len(options))) + 1).cast("int"))


def _doc_id() -> Column:
    return F.substring("file", 4, 30).cast("long")


@query(r"""WITH s AS (SELECT file, line, (['chore: ', 'fmt ', 'Lint', 'whitespace ', 'Bump ', 'dependabot ', 'renovate ', 'deps: ', 'DEPS(x) ', 'deps ', 'depsbuild ', '  ', 'bumpy '])[1 + (CAST(substr(file, 4) AS BIGINT) + line) % 13] || text AS t FROM lines),
l AS (SELECT file, line, regexp_replace(t, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g') AS t FROM s)
SELECT file, line FROM l WHERE length(t) >= 30 AND NOT (lower(t) LIKE 'chore%' OR lower(t) LIKE 'fmt%' OR lower(t) LIKE 'lint%' OR lower(t) LIKE 'whitespace%' OR lower(t) LIKE 'bump %'
  OR lower(t) LIKE 'dependabot%' OR lower(t) LIKE 'renovate%' OR lower(t) LIKE 'deps:%' OR lower(t) LIKE 'deps(%' OR lower(t) LIKE 'deps %')""", needs=("lines",))
def significant_lines(spark, sf_dir):
    """The lines of documents as commit subjects, after beginnings that are noise or nearly so."""
    begin = _nth(["chore: ", "fmt ", "Lint", "whitespace ", "Bump ", "dependabot ", "renovate ", "deps: ", "DEPS(x) ", "deps ", "depsbuild ", "  ", "bumpy "], _doc_id() + F.col("line"))
    return history.significant(B.lines(spark, sf_dir).withColumn("text", F.concat(begin, "text")), "text").select("file", "line")


EDGES_SQL = """WITH n AS (SELECT s_name AS name, 'n' || CAST(s_nationkey AS VARCHAR) AS dst FROM supplier),
u AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS src, s_name AS name, count(*) AS uses
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
h AS (SELECT u.*, n.dst, count(*) OVER (PARTITION BY u.src, u.name) AS k FROM u JOIN (SELECT DISTINCT * FROM n) n ON n.name = u.name WHERE src <> dst),
edges AS (SELECT src, dst, sum(uses / k) AS weight FROM h GROUP BY 1, 2)
"""


def _edges(spark, sf_dir):
    s, c, o, li = (B.table(spark, sf_dir, t) for t in ("supplier", "customer", "orders", "lineitem"))
    defs = s.select(F.col("s_name").alias("name"), F.concat(F.lit("n"), "s_nationkey").alias("file"))
    uses = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.file_edges(defs, uses.select(F.concat(F.lit("n"), "c_nationkey").alias("file"), F.col("s_name").alias("name")))


@query(EDGES_SQL + "SELECT src, dst, round(weight, 8) AS weight FROM edges")
def file_edges(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("weight", F.round("weight", 8))


@query(EDGES_SQL + "SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(weight), 8) AS weight FROM edges GROUP BY 1, 2")
def undirected_edges(spark, sf_dir):
    return graph.undirected(_edges(spark, sf_dir)).withColumn("weight", F.round("weight", 8))


_RANK_SQL = EDGES_SQL + """, nodes AS (SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)), c AS (SELECT count(*) AS n FROM nodes),
sh AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges), dang AS (SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges)),
r0 AS MATERIALIZED (SELECT id, 1.0 / n AS rank FROM nodes, c)"""
for _k in range(1, 7):
    _RANK_SQL += f""",
r{_k} AS MATERIALIZED (SELECT nodes.id, (0.15 / (SELECT n FROM c)) + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{_k - 1} WHERE id IN (SELECT id FROM dang)) / (SELECT n FROM c)) AS rank
  FROM nodes LEFT JOIN (SELECT dst AS id, sum(rank * share) AS got FROM sh JOIN r{_k - 1} ON src = id GROUP BY dst) g ON g.id = nodes.id)"""


@query(_RANK_SQL + "\nSELECT id, round(rank, 8) AS rank FROM r6")
def pagerank_k(spark, sf_dir):
    e = _edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return graph.pagerank(nodes, e, rounds=6, tolerance=0.0).withColumn("rank", F.round("rank", 8))


@query("""WITH d AS (SELECT DISTINCT file, name, parent, qualified_name FROM entities), q AS (SELECT DISTINCT file, name, parent FROM entities),
k AS (SELECT DISTINCT file, name, parent, key FROM (SELECT *, unnest([name, qualified_name]) AS key FROM d)),
x AS (SELECT DISTINCT file AS from_file, caller, name, kind, line FROM refs),
ks AS (SELECT *, unnest(CASE WHEN contains(name, '::') THEN [name, string_split(name, '::')[2], string_split(name, '::')[1]] ELSE [name] END) AS key FROM x),
h AS (SELECT k.file, k.name, k.parent, count(DISTINCT (from_file, caller, ks.name, ks.kind, ks.line)) AS c, count(DISTINCT from_file) AS f FROM k JOIN ks USING (key) GROUP BY 1, 2, 3)
SELECT q.file, q.name, q.parent, coalesce(c, 0) AS direct_callers, coalesce(f, 0) AS direct_files
FROM q LEFT JOIN h ON h.file = q.file AND h.name = q.name AND h.parent IS NOT DISTINCT FROM q.parent""", needs=("entities", "refs"))
def blast_direct(spark, sf_dir):
    return graph.blast_direct(B.entities(spark, sf_dir), B.refs(spark, sf_dir))


_CALLS_SQL = """calls AS (SELECT DISTINCT 'S' || CAST(l_suppkey AS VARCHAR) AS key, 'S' || CAST(1 + (l_suppkey * 7 + l_linenumber) % 97 AS VARCHAR) AS caller FROM lineitem)"""


def _calls(spark, sf_dir):
    caller = F.concat(F.lit("S"), 1 + (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 97)
    return B.table(spark, sf_dir, "lineitem").select(F.lit("f").alias("file"), caller.alias("caller"), F.concat(F.lit("S"), "l_suppkey").alias("name"), F.lit("call").alias("kind"), F.lit(1).cast("long").alias("line")).distinct()


@query("WITH RECURSIVE " + _CALLS_SQL + """, seeds AS (SELECT DISTINCT 'S' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier),
w(seed, node, d) AS (SELECT name, name, 0 FROM seeds UNION SELECT w.seed, calls.caller, w.d + 1 FROM w JOIN calls ON calls.key = w.node WHERE w.d < 3)
SELECT name AS seed, count(DISTINCT CASE WHEN node <> seed THEN node END) AS callers FROM seeds JOIN w ON seed = name GROUP BY name""")
def blast_transitive_depth3(spark, sf_dir):
    seeds = B.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("name"))
    return graph.blast_transitive(seeds, _calls(spark, sf_dir))


_MEMBERS_SQL = """e AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS a, 'n' || CAST(c_nationkey AS VARCHAR) AS b FROM customer
UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier
UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation)"""


def _members(spark, sf_dir):
    """Customers and suppliers tied to their nations, nations to their regions."""
    sides = [("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]
    parts = [B.table(spark, sf_dir, t).select(F.concat(F.lit(p), k).alias("a"), F.concat(F.lit(q), to).alias("b")) for t, p, k, q, to in sides]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("WITH RECURSIVE " + _MEMBERS_SQL + """,
s AS (SELECT DISTINCT * FROM (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e)),
r(id, c) AS (SELECT DISTINCT x, x FROM s UNION SELECT s.y, r.c FROM r JOIN s ON s.x = r.id WHERE r.c < s.y)
SELECT id, min(c) AS component FROM r GROUP BY id""")
def connected_components(spark, sf_dir):
    return graph.components(_members(spark, sf_dir))


@query()
def communities(spark, sf_dir):
    return graph.communities(graph.undirected(_edges(spark, sf_dir)))


@query()
def label_propagation(spark, sf_dir):
    return graph.communities(graph.undirected(_edges(spark, sf_dir)), "labels")


_CONTAINS_SQL = """h AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS child, 'n' || CAST(c_nationkey AS VARCHAR) AS parent FROM customer
UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation)"""


@query("WITH " + _CONTAINS_SQL + """ SELECT child AS id, parent AS ancestor, 1 AS level FROM h
UNION ALL SELECT a.child, b.parent, 2 FROM h a JOIN h b ON a.parent = b.child""")
def ancestor_walk(spark, sf_dir):
    c, n = B.table(spark, sf_dir, "customer"), B.table(spark, sf_dir, "nation")
    h = c.select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return graph.ancestors(h.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))))


@query("""WITH d AS (SELECT o_orderkey, 'p/' || o_orderstatus || '.' || (['go', 'py', 'ts', 'rs', 'java'])[1 + o_custkey % 5] AS file, (['o', 'O', '_o'])[1 + o_custkey % 3] AS pre, (['public', 'private', 'pub', NULL, NULL, NULL, NULL])[1 + o_custkey % 7] AS vis,
  (['Plugin', 'Handler', 'Adapter', 'Middleware', 'Provider', 'Factory', 'Service', 'Controller', ''])[1 + o_custkey % 9] AS suffix FROM orders)
SELECT file, pre || CAST(o_orderkey AS VARCHAR) || suffix AS name, 'function' AS kind, CASE WHEN suffix NOT IN ('', 'Controller') THEN 0.5
  WHEN CASE WHEN vis IS NOT NULL THEN vis <> 'private' WHEN file LIKE '%.go' THEN pre = 'O' WHEN file LIKE '%.py' THEN pre <> '_o' ELSE file NOT LIKE '%.rs' END THEN 0.85 ELSE 0.7 END AS confidence
FROM d WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def dead_code_tiers(spark, sf_dir):
    """Orders are definitions and order lines use them; languages, visibility and ends of names by customer."""
    o, li, k = B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "lineitem"), F.col("o_custkey")
    id_ = F.concat(F.lit("o"), "o_orderkey")
    suffix = _nth(["Plugin", "Handler", "Adapter", "Middleware", "Provider", "Factory", "Service", "Controller", ""], k)
    visibility = F.when(k % 7 == 0, "public").when(k % 7 == 1, "private").when(k % 7 == 2, "pub")
    defs = o.select(F.concat(F.lit("p/"), "o_orderstatus", F.lit("."), _nth(["go", "py", "ts", "rs", "java"], k)).alias("file"), F.concat(_nth(["o", "O", "_o"], k), "o_orderkey", suffix).alias("name"), F.lit("function").alias("kind"), visibility.alias("visibility"), id_.alias("qualified_name"))
    return code.dead_code(defs, li.select(F.concat(F.lit("o"), "l_orderkey").alias("name")), least=0.5)


@query("""WITH f AS (SELECT c_custkey, (['tests/', 'test/', 'a/tests/', 'a/test/', 'a/__tests__/', '__tests__/', 'src/test/', 'latest/', 'a/'])[1 + c_custkey % 9] || (['f', 'test_f', 'Testf'])[1 + (c_custkey // 9) % 3] || CAST(c_custkey AS VARCHAR)
  || (['_test.rs', '_test.go', '_test.py', '_test.ts', '_test.js', '.test.ts', '.test.tsx', '.test.js', '.test.jsx', '.spec.ts', '.spec.tsx', '.spec.js', '.spec.jsx', 'Test.java', 'Tests.java', '_spec.rb', '.py', '.java', '.rs', '.rb', '_spec.js', 'Test.kt', '.MD', '.jsonc', '.lock', '.css'])[1 + (c_custkey // 27) % 26] AS file FROM customer),
n AS (SELECT file, regexp_extract(file, '[^/]*$') AS name FROM f)
SELECT file, starts_with(file, 'tests/') OR starts_with(file, 'test/') OR contains(file, '/tests/') OR contains(file, '/test/') OR contains(file, '/__tests__/')
  OR len(list_filter(['_test.rs', '_test.go', '_test.py', '_test.ts', '_test.js', '.test.ts', '.test.tsx', '.test.js', '.test.jsx', '.spec.ts', '.spec.tsx', '.spec.js', '.spec.jsx', 'Test.java', 'Tests.java', '_spec.rb'], lambda e: ends_with(name, e))) > 0
  OR (starts_with(name, 'test_') AND (ends_with(name, '.py') OR ends_with(name, '.rs'))) OR (starts_with(name, 'Test') AND ends_with(name, '.java')) AS test,
  ends_with(lower(file), '.md') OR ends_with(lower(file), '.jsonc') AS other FROM n""")
def path_kinds(spark, sf_dir):
    """Paths by customer: which are tests, and which hold no source."""
    k = F.col("c_custkey")
    ends = ["_test.rs", "_test.go", "_test.py", "_test.ts", "_test.js", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", "Test.java", "Tests.java", "_spec.rb", ".py", ".java", ".rs", ".rb", "_spec.js", "Test.kt", ".MD", ".jsonc", ".lock", ".css"]
    folder = _nth(["tests/", "test/", "a/tests/", "a/test/", "a/__tests__/", "__tests__/", "src/test/", "latest/", "a/"], k)
    file = F.concat(folder, _nth(["f", "test_f", "Testf"], F.floor(k / 9)), "c_custkey", _nth(ends, F.floor(k / 27)))
    return B.table(spark, sf_dir, "customer").select(file.alias("file")).select("file", names.is_test_path(F.col("file")).alias("test"), names.is_non_source(F.col("file")).alias("other"))


@query("""WITH d AS (SELECT qualified_name AS name, min(file) AS target FROM entities GROUP BY 1 HAVING count(*) = 1)
SELECT refs.name, count(*) AS n, any_value(target) AS target, 0.5 AS confidence FROM refs JOIN d ON d.name = refs.name WHERE refs.kind = 'call' GROUP BY refs.name""", needs=("entities", "refs"))
def resolve_unique_global(spark, sf_dir):
    return code.unique_global(B.refs(spark, sf_dir), B.entities(spark, sf_dir).withColumn("name", F.col("qualified_name")))


@query("""WITH u AS (SELECT name FROM entities GROUP BY name HAVING count(*) = 1), r AS (SELECT DISTINCT file, name, CASE WHEN contains(name, '::') THEN string_split(name, '::')[2] END AS leaf FROM refs)
SELECT file, name, CASE WHEN EXISTS (SELECT 1 FROM entities e WHERE e.file = r.file AND e.name = r.name) THEN 0.95 WHEN name IN (SELECT name FROM u) THEN 0.5
  WHEN leaf IN (SELECT name FROM u) THEN 0.4 ELSE 0.0 END AS confidence FROM r""", needs=("entities", "refs"))
def resolve_cascade(spark, sf_dir):
    return code.cascade(B.refs(spark, sf_dir), B.entities(spark, sf_dir))


@query("SELECT DISTINCT 'external:' || name AS name FROM refs WHERE kind = 'import' AND name NOT IN (SELECT name FROM entities)", needs=("entities", "refs"))
def external_sentinels(spark, sf_dir):
    return code.external_sentinels(B.refs(spark, sf_dir).where("kind = 'import'"), B.entities(spark, sf_dir))


@query(r"SELECT file, line, text FROM lines WHERE regexp_matches(text, '(?i)\b(?:der|the)\b')", needs=("lines",))
def grep_lines(spark, sf_dir):
    return text.grep(B.lines(spark, sf_dir), "der|the", ignore_case=True, word=True)


@query(r"""WITH h AS (SELECT file, line FROM lines WHERE regexp_matches(text, '[0-9]')), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS k FROM h)
SELECT file, count(*) AS n, string_agg(file || ':' || CAST(line AS VARCHAR), ' ' ORDER BY line) FILTER (WHERE k <= 3) AS first FROM r GROUP BY file""", needs=("lines",))
def grep_grouped(spark, sf_dir):
    return text.grouped(text.grep(B.lines(spark, sf_dir), "[0-9]"), "file")


@query(r"""WITH l AS (SELECT 'doc' || d || '.' || (['py', 'rs', 'js', 'rb', 'java', 'tsx'])[1 + d % 6] AS file, line, (['py', 'rs', 'js', 'rb', 'java', 'tsx'])[1 + d % 6] AS ext, text || ' ' || (['eval (x)', 'exec(x)', 'pickle.loads(x)', 'subprocess.run(x, shell = True)', 'os.system(x)', 'password = "x"',
  'api_key="x"', 'f"SELECT {x}"', 'c.execute("SELECT a" + x)', 'verify=False', 'md5 sha1', 'evaluate(x) execute(x) sha10'])[1 + (d + line) % 12] AS text FROM (SELECT *, CAST(substr(file, 4) AS BIGINT) AS d FROM lines)),
r(kind, severity, p, ext) AS (VALUES
  ('eval_call', 'high', '\beval\s*\(', ['py', 'js', 'ts', 'tsx', 'jsx', 'rb', 'php']), ('exec_call', 'high', '\bexec\s*\(', ['py', 'js', 'ts', 'tsx', 'jsx', 'rb', 'php']), ('pickle_loads', 'high', 'pickle\.loads', ['py']),
  ('subprocess_shell_true', 'high', 'subprocess\..*shell\s*=\s*True', ['py']), ('os_system', 'high', '\bos\.system', ['py', 'rb']), ('hardcoded_password', 'high', 'password\s*=\s*[''"]', NULL),
  ('hardcoded_secret', 'high', '(?:api_?key|secret)\s*=\s*[''"]', NULL), ('fstring_sql', 'med', 'f[''"].*SELECT.*\{.*\}', ['py']), ('concat_sql', 'med', '\.execute\(\s*[''"]\s*SELECT.*\+', NULL),
  ('tls_verify_false', 'med', 'verify\s*=\s*False', ['py']), ('weak_hash', 'low', '\bmd5\b|\bsha1\b', NULL))
SELECT file, line, kind, severity FROM l, r WHERE (r.ext IS NULL OR list_contains(r.ext, l.ext)) AND regexp_matches(text, p)""", needs=("lines",))
def pattern_scan(spark, sf_dir):
    """The lines of documents as sources of six languages, each with a piece of code that some rule may find."""
    ext = _nth(["py", "rs", "js", "rb", "java", "tsx"], _doc_id())
    pieces = ["eval (x)", "exec(x)", "pickle.loads(x)", "subprocess.run(x, shell = True)", "os.system(x)", 'password = "x"', 'api_key="x"', 'f"SELECT {x}"', 'c.execute("SELECT a" + x)', "verify=False", "md5 sha1", "evaluate(x) execute(x) sha10"]
    piece = _nth(pieces, _doc_id() + F.col("line"))
    lines = B.lines(spark, sf_dir).select(F.concat("file", F.lit("."), ext).alias("file"), "line", F.concat("text", F.lit(" "), piece).alias("text"))
    return text.pattern_scan(lines, text.SECURITY, F.substring_index("file", ".", -1))


@query(r"""SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''), '\?.*$', ''), '\$?\{[^}/]*\}', '{param}', 'g'), '<[^>/]*>', '{param}', 'g'), ':[A-Za-z_][A-Za-z0-9_]*', '{param}', 'g'), '\[[^\]/]*\]', '{param}', 'g')), '(.)/+$', '\1') AS p FROM pages)""")
def normalize_urls(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", names.normalize_path(F.col("url")).alias("path"))


@query("SELECT conv_id, turn, CAST((octet_length(encode(text)) + 3) // 4 AS BIGINT) AS tokens FROM conversations")
def token_estimate(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", names.token_estimate(F.col("text")).alias("tokens"))


@query(r"""SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS identifiers FROM (SELECT conv_id, turn,
list_filter(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)', 1), lambda w: length(w) >= 3 AND (contains(w, '_') OR regexp_matches(w, '[a-z][A-Z]'))) AS l FROM conversations)""")
def identifiers(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(names.identifiers(F.col("text")), ",").alias("identifiers"))


@query("""SELECT file, name, score, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, name) AS n
FROM (SELECT file, name, max(line_end - line_start) AS score FROM entities GROUP BY file, name)) WHERE n <= 5""", needs=("entities",))
def map_topk_per_file(spark, sf_dir):
    scored = B.entities(spark, sf_dir).groupBy("file", "name").agg(F.max(F.col("line_end") - F.col("line_start")).alias("score"))
    return code.map_files(scored, 5)


@query("""SELECT file, score, tokens, total FROM (SELECT *, CAST(100 + sum(tokens) OVER (ORDER BY score DESC, file ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total, row_number() OVER (ORDER BY score DESC, file) AS n
FROM (SELECT file, count(*) AS score, CAST(sum(length(name)) AS BIGINT) AS tokens FROM entities GROUP BY file)) WHERE total <= 5000 OR n = 1""", needs=("entities",))
def map_budget_prefix(spark, sf_dir):
    files = B.entities(spark, sf_dir).groupBy("file").agg(F.count("*").alias("score"), F.sum(F.length("name")).cast("long").alias("tokens"))
    return code.budget_prefix(files, 5000)


def _snapshots(spark, sf_dir):
    """The customers, and the same after every 11th left, every 7th moved and every 5th changed."""
    c = B.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.select(F.concat(F.lit("m"), "c_nationkey").alias("file"), F.lit(None).cast("string").alias("parent"), F.col("c_name").alias("name"), F.concat(F.lit("b"), k).alias("body_hash"), F.concat(F.lit("s"), k).alias("sig_hash"))
    new = c.where(k % 11 != 0).select(
        F.concat(F.lit("m"), F.col("c_nationkey") + F.when(k % 7 == 0, 100).otherwise(0)).alias("file"), F.lit(None).cast("string").alias("parent"),
        F.when(k % 13 == 0, F.concat("c_name", F.lit("_new"))).otherwise(F.col("c_name")).alias("name"), F.concat(F.lit("b"), F.when((k % 5 == 0) & (k % 13 != 0), -k).otherwise(k)).alias("body_hash"), F.concat(F.lit("s"), F.when((k % 10 == 0) & (k % 13 != 0), -k).otherwise(k)).alias("sig_hash"),
    )
    return code.classify(code.match_snapshots(old, new))


_CHANGES_SQL = """changes AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN 'removed' WHEN c_custkey % 13 = 0 THEN 'renamed' WHEN c_custkey % 7 = 0 THEN 'moved'
  WHEN c_custkey % 5 = 0 THEN 'modified' END AS change, c_custkey % 10 = 0 AS sig FROM customer)"""


@query("WITH " + _CHANGES_SQL + " SELECT name, change, CASE WHEN change IN ('removed', 'renamed') THEN true ELSE sig END AS breaking FROM changes WHERE change IS NOT NULL")
def classify_changes(spark, sf_dir):
    return _snapshots(spark, sf_dir).select(F.coalesce("old.name", "new.name").alias("name"), "change", "breaking")


@query("WITH " + _CHANGES_SQL + " SELECT change, count(*) AS n, bool_or(CASE WHEN change IN ('removed', 'renamed') THEN true ELSE sig END) AS breaking FROM changes WHERE change IS NOT NULL GROUP BY change")
def diff_summary(spark, sf_dir):
    return _snapshots(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"), F.bool_or("breaking").alias("breaking"))


@query("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def json_keys(spark, sf_dir):
    return config.json_keys(B.table(spark, sf_dir, "events"), "props")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<script[^>]*>')) AS INTEGER) AS blocks FROM pages")
def script_blocks(spark, sf_dir):
    return config.script_blocks(B.table(spark, sf_dir, "pages"))


@query("SELECT file, name, kind, parent, line_start, line_end, qualified_name, body_hash FROM entities WHERE file = 'src/brand_2.py' AND parent = 'ECONOMY'", needs=("entities",))
def children_of(spark, sf_dir):
    return code.file_symbols(B.entities(spark, sf_dir), "src/brand_2.py", None, "ECONOMY")


@query("""WITH e AS (SELECT DISTINCT regexp_extract(name, '([^:.]*)$', 1) AS name, parent, file FROM entities WHERE parent IS NOT NULL)
SELECT name, parent, file, other_parent, other_file FROM (SELECT a.name, a.parent, a.file, b.parent AS other_parent, b.file AS other_file,
row_number() OVER (PARTITION BY a.name, a.parent, a.file ORDER BY b.file, b.parent) AS k FROM e a JOIN e b ON a.name = b.name AND a.parent <> b.parent) WHERE k <= 5""", needs=("entities",))
def overrides(spark, sf_dir):
    return resolve.overrides(B.entities(spark, sf_dir))


@query("""WITH k AS (SELECT file AS id, count(*) / 1000.0 AS rank FROM refs WHERE kind = 'import' GROUP BY 1)
SELECT DISTINCT file, line, coalesce(rank, 0.0) AS rank FROM refs LEFT JOIN k ON file = id, (SELECT min(p_name) AS x FROM part) WHERE name = x OR ends_with(name, '::' || x)""", needs=("refs",))
def impact_report(spark, sf_dir):
    """Who calls the first part; a file's rank is how much it imports."""
    r = B.refs(spark, sf_dir)
    rank = r.where("kind = 'import'").groupBy(F.col("file").alias("id")).agg((F.count("*") / 1000.0).alias("rank"))
    return Engine(B.entities(spark, sf_dir), r).ranked_callers(B.table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0], rank)


@query("SELECT c_name AS child, 'extend' AS kind, 'geo.n' || CAST(c_nationkey AS VARCHAR) AS target FROM customer WHERE c_nationkey = 3")
def heritage_incoming(spark, sf_dir):
    edges = B.table(spark, sf_dir, "customer").select(F.col("c_name").alias("child"), F.lit("extend").alias("kind"), F.concat(F.lit("geo.n"), "c_nationkey").alias("target"))
    return code.heritage(edges, "n3")


_CUSTOMER_CHANGES_SQL = """ch AS (SELECT 'm' || CAST(c_nationkey AS VARCHAR) AS file, CASE WHEN c_custkey % 2 = 0 THEN 'C.' ELSE '' END || c_mktsegment AS name,
CASE c_custkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'formatting' END AS change FROM customer)"""


def _customer_changes(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("m"), "c_nationkey").alias("file"), F.concat(F.when(k % 2 == 0, "C.").otherwise(""), "c_mktsegment").alias("name"), F.when(k % 3 == 0, "added").when(k % 3 == 1, "modified").otherwise("formatting").alias("change"))


@query("WITH " + _CUSTOMER_CHANGES_SQL + """ SELECT change, regexp_extract(name, '([^:.]*)$', 1) AS tail, count(*) AS n, count(DISTINCT file) AS files
FROM ch WHERE change <> 'formatting' GROUP BY 1, 2 HAVING count(DISTINCT file) >= 2""")
def cross_file_patterns(spark, sf_dir):
    return diff.cross_file_patterns(_customer_changes(spark, sf_dir))


@query("WITH " + _CUSTOMER_CHANGES_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY name, change) AS k FROM ch)
SELECT file, count(*) AS n, string_agg(name, ', ' ORDER BY k) FILTER (WHERE k <= 3) || CASE WHEN count(*) > 3 THEN ' +' || CAST(count(*) - 3 AS VARCHAR) || ' more' ELSE '' END AS label FROM r GROUP BY file""")
def change_groups(spark, sf_dir):
    return diff.change_groups(_customer_changes(spark, sf_dir))


@query("""WITH b AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS f FROM orders GROUP BY 1)
SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS file, c_name AS name, CAST(NULL AS VARCHAR) AS parent, c_acctbal < 0 AS breaking, coalesce(f, 0) AS direct_files,
round(coalesce(n_nationkey / 25.0, 0) * (ln(1 + coalesce(f, 0)) + 1) * CASE WHEN c_acctbal < 0 THEN 3.0 ELSE 1.0 END, 8) AS impact
FROM customer LEFT JOIN b ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def review_impact(spark, sf_dir):
    c, o, n = (B.table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    at = [F.concat(F.lit("n"), "c_nationkey").alias("file"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("parent")]
    uses = o.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("direct_files"))
    blast = c.join(uses, F.col("o_custkey") == F.col("c_custkey")).select(*at, "direct_files")
    rank = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), (F.col("n_nationkey") / 25.0).alias("rank"))
    return diff.review_impact(c.select(*at, (F.col("c_acctbal") < 0).alias("breaking")), rank, blast).withColumn("impact", F.round("impact", 8))


@query("""SELECT DISTINCT 'function' AS kind, p_brand AS file, CAST(NULL AS VARCHAR) AS parent, p_name AS old_name, p_name || 's' AS new_name,
round(2.0 * length(p_name) / (2 * length(p_name) + 1), 8) AS ratio FROM part""")
def match_fuzzy(spark, sf_dir):
    """Every part of a brand renamed by a letter."""
    old = B.table(spark, sf_dir, "part").select(F.lit("function").alias("kind"), F.col("p_brand").alias("file"), F.lit(None).cast("string").alias("parent"), F.col("p_name").alias("name")).distinct()
    return diff.fuzzy_renames(old, old.withColumn("name", F.concat("name", F.lit("s")))).withColumn("ratio", F.round("ratio", 8))


@query("""SELECT conv_id, turn, '+' AS sign, CAST(length(text) - length(replace(text, chr(10), '')) + 2 AS BIGINT) AS line, 'more' AS text FROM conversations WHERE text IS NOT NULL
UNION ALL SELECT conv_id, turn, '+', 1, '' FROM conversations WHERE text = ''""")
def inline_line_diff(spark, sf_dir):
    """Every turn with a line more."""
    c = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("old"), F.concat("text", F.lit("\nmore")).alias("new"))
    return diff.line_diffs(c, ["conv_id", "turn"])


@query(r"""WITH p AS (SELECT doc_id, text, doc_id % 8 AS k, (doc_id // 8) % 10 AS j FROM documents WHERE text IS NOT NULL),
f AS (SELECT k, (['a/', 'b.c/'])[1 + doc_id % 2] || CASE WHEN k = 0 AND j = 0 THEN 'urls.py' WHEN k = 0 AND j = 1 THEN 'views.py' ELSE 'f' || CAST(doc_id AS VARCHAR) || (['.py', '.go', '.js', '.ts', '.kt', '.swift', '.scala', '.php'])[1 + k] END AS file,
text || chr(10) || (['@app.route("/a")', '@ router.post( ''/a'')', 'mux.HandleFunc("/a", h)', 'r.Get("/a")', 'r.GET("/a")', 'app.get("/a")', '@Injectable()', '{get("/a")', 'path("a") { Action.async (x) {', 'Route::any("/a") #[ Route("/b")'])[1 + j] AS text FROM p),
t AS (SELECT file, CASE
  WHEN ends_with(file, '/urls.py') THEN 'django_urls' WHEN ends_with(file, '/views.py') THEN 'django_views'
  WHEN k = 0 AND regexp_matches(text, '@\s*[A-Za-z_]\w*\.route\(\s*["''][^"'']+["'']') THEN 'flask_route'
  WHEN k = 0 AND regexp_matches(text, '@\s*[A-Za-z_]\w*\.(get|post|put|delete|patch|options|head)\(\s*["''][^"'']+["'']') THEN 'fastapi_route'
  WHEN k = 1 AND regexp_matches(text, '\b[A-Za-z_]\w*\.HandleFunc\(\s*["''`][^"''`]+["''`]') THEN 'go_net_http'
  WHEN k = 1 AND regexp_matches(text, '\b[A-Za-z_]\w*\.(Get|Post|Put|Delete|Patch|Options|Head)\(\s*["''`][^"''`]+["''`]') THEN 'go_chi'
  WHEN k = 1 AND regexp_matches(text, '\b[A-Za-z_]\w*\.(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\(\s*["''`][^"''`]+["''`]') THEN 'go_gin_echo'
  WHEN k IN (2, 3) AND regexp_matches(text, '\b[A-Za-z_]\w*\.(get|post|put|delete|patch|options|head|all)\(\s*["''`][^"''`]+["''`]') THEN 'express_route'
  WHEN k IN (2, 3) AND regexp_matches(text, '@(Controller|Get|Post|Put|Delete|Patch|Options|Head|All|Module|Injectable)\b') THEN 'nestjs_decorator'
  WHEN k = 4 AND regexp_matches(text, '(^|\s|\{)(get|post|put|delete|patch|options|head)\(\s*"[^"]+"') THEN 'ktor_route'
  WHEN k = 4 AND regexp_matches(text, '@(RestController|Controller|(Get|Post|Put|Delete|Patch|Request)Mapping)\b') THEN 'spring_annotation'
  WHEN k = 5 AND regexp_matches(text, '\b[A-Za-z_]\w*\.(get|post|put|delete|patch|options|head)\(\s*"[^"]+"') THEN 'vapor_route'
  WHEN k = 6 AND regexp_matches(text, '\bpath\(\s*"[^"]+"\s*\)\s*\{') THEN 'akka_http_route' WHEN k = 6 AND regexp_matches(text, '\bAction(\.async)?\s*(\([^)]*\)\s*)?\{') THEN 'play_action'
  WHEN k = 7 AND regexp_matches(text, '\bRoute::(get|post|put|delete|patch|options|any|match|resource|view|redirect)\(\s*["''][^"'']+["'']') THEN 'laravel_route'
  WHEN k = 7 AND regexp_matches(text, '#\[\s*Route\s*\(\s*["''][^"'']+["'']') THEN 'symfony_route' END AS framework FROM f)
SELECT file, framework FROM t WHERE framework IS NOT NULL""")
def framework_entries(spark, sf_dir):
    """Documents as sources of eight languages, each with a line that some framework looks for."""
    d = B.table(spark, sf_dir, "documents").where("text is not null")
    k, j = F.col("doc_id") % 8, F.floor(F.col("doc_id") / 8) % 10
    plain = F.concat(F.lit("f"), "doc_id", _nth([".py", ".go", ".js", ".ts", ".kt", ".swift", ".scala", ".php"], k))
    name = F.when((k == 0) & (j == 0), "urls.py").when((k == 0) & (j == 1), "views.py").otherwise(plain)
    pieces = ['@app.route("/a")', "@ router.post( '/a')", 'mux.HandleFunc("/a", h)', 'r.Get("/a")', 'r.GET("/a")', 'app.get("/a")', "@Injectable()", '{get("/a")', 'path("a") { Action.async (x) {', 'Route::any("/a") #[ Route("/b")']
    files = d.select(F.concat(_nth(["a/", "b.c/"], F.col("doc_id")), name).alias("file"), F.concat("text", F.lit("\n"), _nth(pieces, j)).alias("text"))
    return text.framework_files(files, names.language(F.col("file")))


@query("""SELECT conv_id, turn, 'value_changed' AS change, CAST(turn AS VARCHAR) AS was, CAST(turn + 1 AS VARCHAR) AS now FROM conversations WHERE (conv_id + turn) % 5 = 0
UNION ALL SELECT conv_id, turn, 'argument_changed', 'a' || CAST(turn AS VARCHAR), 'b' || CAST(turn AS VARCHAR) FROM conversations WHERE (conv_id + turn) % 5 = 1
UNION ALL SELECT conv_id, turn, 'comment_changed', 'old', 'new' FROM conversations WHERE (conv_id + turn) % 5 = 2
UNION ALL SELECT conv_id, turn, 'line_removed', 'gone with it', '' FROM conversations WHERE (conv_id + turn) % 5 = 3
UNION ALL SELECT conv_id, turn, 'line_added', '', 'altogether new' FROM conversations WHERE (conv_id + turn) % 5 >= 3""")
def change_details(spark, sf_dir):
    """Every turn with a line of code more or changed, of five kinds."""
    kind, n, m = (F.col("conv_id") + F.col("turn")) % 5, F.col("turn").cast("string"), (F.col("turn") + 1).cast("string")
    old = F.when(kind == 0, F.concat(F.lit("turn = "), n)).when(kind == 1, F.concat(F.lit("f(x, a"), n, F.lit(", y, z)"))).when(kind == 2, "x = y # old thing here").when(kind == 3, "gone with it")
    new = F.when(kind == 0, F.concat(F.lit("turn = "), m)).when(kind == 1, F.concat(F.lit("f(x, b"), n, F.lit(", y, z)"))).when(kind == 2, "x = y # new thing here").otherwise("altogether new")
    c = B.table(spark, sf_dir, "conversations").where("text is not null")
    text_ = lambda line: F.concat_ws("\n", "text", line)
    return diff.token_changes(c.select("conv_id", "turn", text_(old).alias("old"), text_(new).alias("new")), ["conv_id", "turn"])


_MODULES_SQL = """m AS (SELECT DISTINCT 'src/' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g')) || '/' || lower(o_orderstatus) || '.py' AS file,
'src/brand_' || CAST(1 + o_custkey % 3 AS VARCHAR) || '.py' AS target FROM orders)"""


@query("WITH " + _MODULES_SQL + """, d AS (SELECT DISTINCT file AS target, name FROM entities), r AS (SELECT DISTINCT file, name FROM refs WHERE kind = 'call')
SELECT file, name, min(target) AS target, 0.85 AS confidence FROM r JOIN m USING (file) JOIN d USING (target, name) GROUP BY file, name HAVING count(*) = 1""", needs=("entities", "refs"))
def resolve_imported(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    at = F.concat(F.lit("src/"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "_")), F.lit("/"), F.lower("o_orderstatus"), F.lit(".py"))
    modules = o.select(at.alias("file"), F.concat(F.lit("src/brand_"), 1 + F.col("o_custkey") % 3, F.lit(".py")).alias("target")).distinct()
    return resolve.imported(B.refs(spark, sf_dir), modules, B.entities(spark, sf_dir))


@query(r"""WITH u AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
x AS (SELECT DISTINCT regexp_extract(path, '^[^/]*') AS prefix FROM u UNION SELECT regexp_extract(path, '^[^/]*/[^/]*') FROM u WHERE contains(path, '.com/'))
SELECT path, max_by(prefix, length(prefix)) AS prefix FROM u JOIN x ON path = prefix OR starts_with(path, prefix || '/') GROUP BY path""")
def longest_prefix(spark, sf_dir):
    """Each page's address with its host, or its host and first folder where the host is a .com."""
    u = B.table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    long = u.where(F.contains("path", F.lit(".com/"))).select(F.regexp_extract("path", "^([^/]*/[^/]*)", 1).alias("prefix"))
    return code.longest_prefix(u, u.select(F.regexp_extract("path", "^([^/]*)", 1).alias("prefix")).unionByName(long))


@query("""WITH p AS (SELECT DISTINCT 'o' || CAST(l_orderkey AS VARCHAR) AS file, CAST(l_linenumber AS BIGINT) AS line FROM lineitem),
s AS (SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS file, 'd' || CAST(l_partkey AS VARCHAR) AS doc, CAST(l_linenumber AS BIGINT) AS e FROM lineitem WHERE l_returnflag = 'R')
SELECT file, line, doc, doc_end FROM (SELECT p.file, p.line, doc, e AS doc_end, row_number() OVER (PARTITION BY p.file, p.line ORDER BY e DESC, doc DESC) AS k FROM p JOIN s ON p.file = s.file AND e < line AND line - e <= 2) WHERE k = 1""")
def nearest_before(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line"), F.concat(F.lit("d"), "l_partkey").alias("name"), "l_returnflag")
    return code.nearest_before(li.select("file", "line").distinct(), li.where("l_returnflag = 'R'").select("file", "name", F.col("line").alias("line_end")))


@query("""WITH h AS (SELECT DISTINCT file, line_start + 3 AS line FROM entities), j AS (SELECT h.file, h.line, e.name, e.line_start, e.line_end FROM h LEFT JOIN entities e ON e.file = h.file AND h.line BETWEEN e.line_start AND e.line_end)
SELECT file, line, name AS entity FROM (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY line_start DESC NULLS LAST, line_end, name DESC) AS k FROM j) WHERE k = 1""", needs=("entities",))
def grep_enclosing(spark, sf_dir):
    e = B.entities(spark, sf_dir)
    return code.enclosing(e.select("file", (F.col("line_start") + 3).alias("line")).distinct(), e)


_TURN_LINES = "turns AS (SELECT conv_id, turn, role, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS line, unnest(l) AS text FROM (SELECT *, string_split(text, chr(10)) AS l FROM conversations WHERE text IS NOT NULL))"


@query("WITH " + _TURN_LINES + r""", l AS (SELECT 'c' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS file, line,
(['# decision: ', '// WHY:', '-- Rationale: ', '# TRADEOFF:  ', '  # adr: ', '//rejected: ', '# NOTE: ', '# WHY : ', 'WHY: ', ''])[1 + (conv_id + turn + line) % 10] || text AS text FROM turns)
SELECT file, line, upper(regexp_extract(text, '(?i)^\s*(?:#|//|--)\s*(DECISION|WHY|RATIONALE|TRADEOFF|ADR|REJECTED):', 1)) AS marker, regexp_extract(text, '(?i)^\s*(?:#|//|--)\s*[A-Z]+:\s*(\S.*?)\s*$', 1) AS note
FROM l WHERE regexp_matches(text, '(?i)^\s*(?:#|//|--)\s*(DECISION|WHY|RATIONALE|TRADEOFF|ADR|REJECTED):\s*\S.*$')""")
def marker_scan(spark, sf_dir):
    """All lines of conversations as comments with markers, or nearly."""
    t = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("line", (F.col("pos") + 1).cast("long"))
    begin = _nth(["# decision: ", "// WHY:", "-- Rationale: ", "# TRADEOFF:  ", "  # adr: ", "//rejected: ", "# NOTE: ", "# WHY : ", "WHY: ", ""], F.col("conv_id") + F.col("turn") + F.col("line"))
    return text.markers(t.select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("file"), "line", F.concat(begin, "text").alias("text")))


@query("WITH " + _TURN_LINES + r""", l AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS sha, CASE WHEN turn % 2 = 0 THEN role ELSE 'HEAD' END AS file,
CASE WHEN line = 1 THEN (['Why: ', 'decision: ', 'TRADEOFF: ', 'Refactor for: ', 'rationale: ', 'Wherefore: ', ''])[1 + (conv_id + turn) % 7] ELSE '' END || text AS text FROM turns)
SELECT sha, file, CASE lower(split_part(ltrim(text), ':', 1)) WHEN 'why' THEN 'Why' WHEN 'decision' THEN 'Decision' WHEN 'tradeoff' THEN 'Tradeoff' WHEN 'refactor for' THEN 'Refactor for' ELSE 'Rationale' END AS marker,
regexp_extract(text, '(?i)^\s*[A-Z ]+?:\s*(\S.*?)\s*$', 1) AS note FROM l WHERE regexp_matches(text, '(?i)^\s*(Why|Decision|Tradeoff|Refactor for|Rationale):\s*\S.*$')""")
def commit_marker_scan(spark, sf_dir):
    """Turns of conversations as commit messages, whose first lines begin with markers, or nearly."""
    c = B.table(spark, sf_dir, "conversations")
    begin = _nth(["Why: ", "decision: ", "TRADEOFF: ", "Refactor for: ", "rationale: ", "Wherefore: ", ""], F.col("conv_id") + F.col("turn"))
    return text.commit_markers(c.select(F.concat_ws("-", "conv_id", "turn").alias("sha"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("file"), F.concat(begin, "text").alias("message")))


_PATH_SQL = ORACLES["normalize_urls"].removesuffix(" FROM pages)").split("FROM (SELECT page_id, ", 1)[1].removesuffix(" AS p")


@query("WITH q AS (SELECT DISTINCT page_id % 3 AS c, " + _PATH_SQL + """ AS p FROM pages)
SELECT 'http::GET::' || CASE WHEN p = '' THEN '/' ELSE p END AS contract_id, 'api' AS provider_repo, 'app' || CAST(c AS VARCHAR) AS consumer_repo, 0.95 AS confidence FROM q""")
def contract_links(spark, sf_dir):
    """One repository offers every page, three others ask for them."""
    p = B.table(spark, sf_dir, "pages")
    provider = p.select(F.lit("api/routes.py").alias("file"), F.col("page_id").alias("line"), F.concat(F.lit("@app.get('"), "url", F.lit("')")).alias("text"))
    consumer = p.select(F.concat(F.lit("app"), F.col("page_id") % 3, F.lit("/calls.ts")).alias("file"), F.col("page_id").alias("line"), F.concat(F.lit("axios.get('"), "url", F.lit("')")).alias("text"))
    found = text.contracts(provider.unionByName(consumer), names.language(F.col("file")))
    return text.contract_links(found.withColumn("repo", F.substring_index("file", "/", 1)))


@query("""SELECT 'c' || CAST(o_custkey AS VARCHAR) || '/' || o_orderpriority AS file, 1.0 AS confidence FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey
GROUP BY 1 HAVING count(l_orderkey) = 0""")
def unreferenced_files(spark, sf_dir):
    o, li = B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "lineitem")
    key = F.concat(F.lit("o"), "o_orderkey")
    return code.unreferenced_files(o.select(F.concat(F.lit("c"), "o_custkey", F.lit("/"), "o_orderpriority").alias("file"), key.alias("name"), key.alias("qualified_name")), li.select(F.concat(F.lit("o"), "l_orderkey").alias("name")))


@query("""WITH m AS (SELECT c_nationkey AS community, 'r' || CAST(n_regionkey AS VARCHAR) || '/' || c_mktsegment || '/' || c_name AS file, c_acctbal AS rank FROM customer JOIN nation ON n_nationkey = c_nationkey),
t AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY rank DESC, length(file), file) AS k, count(*) OVER (PARTITION BY community) AS files, count(DISTINCT string_split(file, '/')[2]) OVER (PARTITION BY community) AS segments FROM m)
SELECT community, files, file AS representative, CASE WHEN segments = 1 THEN regexp_extract(file, '^(.*)/', 1) ELSE string_split(file, '/')[1] END AS label FROM t WHERE k = 1""")
def cluster_summaries(spark, sf_dir):
    c, n = B.table(spark, sf_dir, "customer"), B.table(spark, sf_dir, "nation")
    m = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_nationkey").alias("community"), F.concat(F.lit("r"), "n_regionkey", F.lit("/"), "c_mktsegment", F.lit("/"), "c_name").alias("file"), F.col("c_acctbal").alias("rank"))
    return cluster_summary(m)


@query("SELECT role, median((octet_length(encode(text)) + 3) // 4) AS tokens, count(*) AS n FROM conversations GROUP BY role")
def token_median(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").groupBy("role").agg(F.median(names.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("n"))
