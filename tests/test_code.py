"""Operators over entities, refs, commits and lines on small inputs, and every query against its SQL."""

import glob
import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.operators import code, graph, history, text
from lodestone.plans import catalog
from lodestone.sources import config

DATA = "/root/testdata/sf0.001"


def ent(spark, rows):
    full = [dict.fromkeys(["parent", "qualified_name", "body_hash", "sig_hash"]) | {"line_start": 1, "line_end": 2, "kind": "function"} | r for r in rows]
    schema = "file string, name string, kind string, line_start long, line_end long, parent string, qualified_name string, body_hash string, sig_hash string"
    return spark.createDataFrame([tuple(r[c] for c in ("file", "name", "kind", "line_start", "line_end", "parent", "qualified_name", "body_hash", "sig_hash")) for r in full], schema)


def refr(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], "call", 1) for r in rows], "file string, caller string, name string, kind string, line long")


@pytest.mark.parametrize(
    ("name", "finds", "misses"),
    [("crate::a::b::work", ["work", "crate::a::b"], ["a"]), ("Maker::new", ["new", "Maker"], ["Make"]), ("obj.helper", ["helper", "obj.helper"], ["obj"]), ("plainname", ["plainname"], ["plain"]), ("Outer::Inner.new", ["new", "Outer::Inner", "Inner"], ["Outer.new"])],
)
def test_alias_keys(spark, name, finds, misses):
    keys = spark.range(1).select(names.alias_keys(F.lit(name)).alias("k")).first()["k"]
    assert set(finds) <= set(keys) and not set(misses) & set(keys)


def test_paths_and_words(spark):
    df = spark.createDataFrame([("https://h.example/Users/:id/?q=1",), ("/a/{x}/<y>/",), ("",), (None,)], "u string")
    assert [r[0] for r in df.select(names.normalize_path(F.col("u"))).collect()] == ["/users/{param}", "/a/{param}/{param}", "/", None]
    got = spark.range(1).select(names.camel_to_snake(F.lit("HTTPServerName")), names.truncate(F.lit("abcdef"), 4), names.token_estimate(F.lit("abcde"))).first()
    assert list(got) == ["http_server_name", "abc…", 2]


def test_points(spark):
    e = ent(spark, [{"file": "a.py", "name": "one"}, {"file": "a.py", "name": "one", "line_start": 5, "line_end": 9}, {"file": "b.py", "name": "two", "parent": "C"}])
    r = refr(spark, [("b.py", "C.two", "one"), ("a.py", None, "two"), ("a.py", "x", "gone")])
    assert code.callers(r, "one").count() == 1 and code.callees(r, "C").count() == 1
    assert {(x["caller"], x["n"]) for x in code.grouped(r, "caller").collect()} == {("C.two", 1), ("<top-level>", 1), ("x", 1)}
    with pytest.raises(ValueError, match="unknown"):
        code.grouped(r, "line")
    assert code.search(e, "").count() == 0
    assert code.where_defined(e, "one").first()["overloads"] == 2
    assert [x["name"] for x in code.did_you_mean(e, "onee").collect()] == ["one"]
    assert {x["name"] for x in code.unreferenced(e, r).collect()} == set()
    assert [x["name"] for x in code.external_sentinels(r, e).collect()] == ["external:gone"]
    hits = spark.createDataFrame([("a.py", 6), ("a.py", 1), ("c.py", 1)], "file string, line long")
    assert {(x["file"], x["line"], x["entity"]) for x in code.enclosing(hits, e).collect()} == {("a.py", 6, "one"), ("a.py", 1, "one"), ("c.py", 1, None)}
    docs = spark.createDataFrame([("a.py", "doc", 4)], "file string, name string, line_end long")
    assert [x["line"] for x in code.nearest_before(hits, docs).collect()] == [6]
    paths = code.longest_prefix(spark.createDataFrame([("m/a/b",), ("x",)], "path string"), spark.createDataFrame([("m",), ("m/a",), ("m/ab",)], "prefix string"))
    assert [tuple(x) for x in paths.collect()] == [("m/a/b", "m/a")]


def test_enclosing_many(spark):
    """Definitions of every length, some nested in many others, against a plain search; none meets each line that it holds."""
    rng = random.Random(5)
    spans = [("f", f"n{k}", a := rng.randint(-3, 300), a + rng.choice([-1, 0, 1, 2, 7, 31, 64, 200])) for k in range(300)] + [("g", "all", 1, (1 << 63) - 1), ("h", "m", 1, 9)]
    spans += [("f", None, 4, None), (None, "x", 1, 400), ("f", "n1", None, 9)]
    e = spark.createDataFrame([(f, n, "module" if f == "h" else "function", a, b) for f, n, a, b in spans], "file string, name string, kind string, line_start long, line_end long")
    at = [(f, n) for f in ("f", "g", "h") for n in range(-5, 510, 3 if f == "f" else 50)] * 2 + [("f", None), (None, 3)]
    hits = spark.createDataFrame(at, "file string, line long")

    def inner(file, line):
        found = [(a, -b, n) for f, n, a, b in spans if None not in (f, a, b, file, line) and f == file != "h" and a <= line <= b]
        return max(found)[2] if found else None

    df = code.enclosing(hits, e)
    assert Counter(map(tuple, df.collect())) == Counter((f, n, inner(f, n)) for f, n in at)
    # a join on the file that compares lines besides would hold each line against each definition of its file
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not any("<=" in x or ">=" in x for x in joins)
    # tables of any size look small by their files; what is broadcast is one row, the sizes of cells
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_snapshots(spark):
    old = ent(spark, [{"file": "a", "name": n, "body_hash": b, "sig_hash": s} for n, b, s in [("same", "1", "1"), ("moved", "2", "2"), ("old", "3", "3"), ("gone", "4", "4"), ("edit", "5", "5")]])
    new = ent(spark, [{"file": f, "name": n, "body_hash": b, "sig_hash": s} for f, n, b, s in [("a", "same", "1", "1"), ("b", "moved", "2", "2"), ("a", "new", "3", "3"), ("a", "edit", "5x", "5"), ("a", "fresh", "6", "6")]])
    got = {((x["old"] or x["new"])["name"], x["change"], x["breaking"]) for x in code.classify(code.match_snapshots(old, new)).collect()}
    assert got == {("moved", "moved", False), ("old", "renamed", True), ("gone", "removed", True), ("edit", "modified", False), ("fresh", "added", False)}


def test_history(spark):
    c = spark.createDataFrame([(1, "a@x", 0, "f"), (1, "a@x", 0, "g"), (2, "a@x", 9, "f"), (2, "a@x", 9, "g"), (3, "b@x", 9, "f")], "sha long, author string, ts long, file string")
    pair = history.cochange(c).first()
    assert (pair["a"], pair["b"], pair["support"]) == ("f", "g", 2) and math.isclose(pair["weight"], 2 / math.sqrt(6))
    own = {x["file"]: (x["owner"], round(x["percent"])) for x in history.ownership(c).collect()}
    assert own == {"f": ("a@x", 67), "g": ("a@x", 100)}
    assert {x["file"]: x["risk"] for x in history.bus_factor(c).collect()} == {"f": "medium", "g": "high"}
    assert history.cochange(c.limit(0)).count() == 0
    e = spark.createDataFrame([("r1", "f", 0), ("r2", "g", 3600), ("r2", "h", 90_001)], "repo string, file string, ts long")
    assert [(x["source_file"], x["target_file"], x["last_date"]) for x in history.cross_repo_cochange(e).collect()] == [("f", "g", "1970-01-01")]


@pytest.mark.parametrize("pairs, events", [(1 << 20, 1 << 19), (200, 1 << 19), (200, 40)])
def test_cross_repo_cochange_blocks(spark, monkeypatch, pairs, events):
    """One block, several, and several in slabs of time, against every pair of events; pairs meet where they are made, not in a join."""
    monkeypatch.setattr(history, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(history, "BLOCK_EVENTS", events)
    rng = random.Random(3)
    rows = [(rng.choice(["r1", "r2", "é", None]), rng.choice(["f", "g", "h", "", None]), rng.choice([rng.randint(0, 40_000), 500, None])) for _ in range(300)] + [(None, "f", 99_999)]
    want: dict = {}
    for k, (r, f, t) in enumerate(rows):
        for q, g, u in rows[:k]:
            if None not in (r, q, t, u) and r != q and abs(t - u) <= 900:
                (a, b), at = sorted([(r, f), (q, g)], key=lambda x: x[0]), max(t, u)
                n, strength, last = want.get((*a, *b), (0, 0.0, 0))
                want[*a, *b] = n + 1, strength + math.exp(-(99_999 - at) / 86_400 / 180), max(last, at)
    df = history.cross_repo_cochange(spark.createDataFrame(rows, "repo string, file string, ts long"), 900, most=None, digits=6)
    got = {tuple(x)[:4]: (x["frequency"], x["strength"], x["last_unix"]) for x in df.collect()}
    assert len(got) == df.count() and {k: (v[0], v[2]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}
    assert all(math.isclose(v[1], want[k][1], abs_tol=1e-6) for k, v in got.items())
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    t = np.array(sorted(x[2] for x in rows if x[2] is not None))
    for same, other in ((True, t), (False, t[::3])):
        found = [p for i, j in history._windows(t, other, 900, same) for p in zip(i.tolist(), j.tolist())]
        assert sorted(found) == [(i, j) for i in range(len(t)) for j in range(i + 1 if same else 0, len(other)) if abs(t[i] - other[j]) <= 900]
    assert history.cross_repo_cochange(spark.createDataFrame([], "repo string, file string, ts long")).count() == 0


@pytest.mark.parametrize("pairs, events, most", [(1 << 20, 1 << 21, 16), (20, 1 << 21, 16), (20, 10, 2)])
def test_cross_repo_cochange_copies(spark, monkeypatch, pairs, events, most):
    """Copies of changes count as often as they are there, in one group, in several and in slabs, but go to a block as one packed row."""
    assert history._shape(6e6, 6e10)[0] <= 16  # an event was copied 339 times
    for name, value in (("BLOCK_PAIRS", pairs), ("BLOCK_EVENTS", events), ("GROUPS", most)):
        monkeypatch.setattr(history, name, value)
    assert history._shape(80, 2000)[1] == (4 if most == 2 else 1)
    rng = random.Random(7)
    rows = [(rng.choice("abc"), rng.choice(["f", "g", None]), rng.randint(0, 9_000)) for _ in range(40)] * 2 + [("a", "f", 9_500)]
    near = [(*sorted([p[:2], q[:2]], key=lambda x: x[0]), max(p[2], q[2])) for k, p in enumerate(rows) for q in rows[:k] if p[0] != q[0] and abs(p[2] - q[2]) <= 600]
    want = Counter((*p, *q) for p, q, _ in near)
    got = {tuple(x)[:4]: x for x in history.cross_repo_cochange(spark.createDataFrame(rows, "repo string, file string, ts long"), 600, most=None, digits=6).collect()}
    assert {k: x["frequency"] for k, x in got.items()} == want
    assert {k: x["last_unix"] for k, x in got.items()} == {(*p, *q): max(t for a, b, t in near if (a, b) == (p, q)) for p, q, _ in near}
    for (*ends,), x in got.items():
        assert math.isclose(x["strength"], sum(math.exp(-(9_500 - t) / 86_400 / 180) for p, q, t in near if [*p, *q] == ends), abs_tol=1e-6)


def test_cross_repo_cochange_halves():
    """Counters for every pair of files, sorted pairs of events, and files halved in between give what a plain count gives."""
    rng = np.random.default_rng(1)

    def some(first, files, size):
        ts = np.sort(rng.integers(0, 3_000, size))
        return history._Packed(first, files, first + rng.integers(0, files, size), ts, rng.integers(1, 4, size), np.exp(ts / 3_000))

    x, y = some(0, 9, 120), some(9, 6, 80)
    for a, b in ((x, x), (x, y), (y, x)):
        want: dict = {}
        for i in range(len(a.ts)):
            for j in range(i + 1 if a is b else 0, len(b.ts)):
                if abs(a.ts[i] - b.ts[j]) <= 100:
                    key, n = (a.code[i], b.code[j]) if a is not b else tuple(sorted((a.code[i], a.code[j]))), a.n[i] * b.n[j]
                    s, f, at = want.get(key, (0.0, 0, 0))
                    want[key] = s + n * max(a.weight[i], b.weight[j]), f + n, max(at, a.ts[i], b.ts[j])
        for limit in (1 << 20, 20, 1):
            got = [r for out in history._tallied(a, b, 100, limit) for r in zip(*(c.tolist() for c in out))]
            assert len(got) == len(want) and all(want[r[:2]][1:] == r[3:] and math.isclose(want[r[:2]][0], r[2]) for r in got)


def test_graph(spark):
    e = ent(spark, [{"file": "hub", "name": "x"}, {"file": "a", "name": "y"}])
    r = refr(spark, [("a", None, "x"), ("b", None, "x"), ("b", None, "y")])
    edges = graph.file_edges(e, r)
    nodes = spark.createDataFrame([("hub",), ("a",), ("b",), ("alone",)], "id string")
    ranks = {x["id"]: x["rank"] for x in graph.pagerank(nodes, edges).collect()}
    assert math.isclose(sum(ranks.values()), 1, abs_tol=1e-6) and max(ranks, key=ranks.get) == "hub"
    cliques = [(f"{s}{i}", f"{s}{j}", 1.0) for s in "pq" for i in range(4) for j in range(i)] + [("p0", "q0", 0.1)]
    for method in ("louvain", "labels"):
        got = graph.communities(spark.createDataFrame(cliques, "a string, b string, weight double"), method).collect()
        groups = {}
        for x in got:
            groups.setdefault(x["community"], set()).add(x["id"][0])
        assert sorted(map(sorted, groups.values())) == [["p"], ["q"]]
    blast = graph.blast_transitive(spark.createDataFrame([("x",)], "name string"), refr(spark, [("f", "a", "x"), ("f", "b", "a"), ("f", "c", "b"), ("f", "d", "c")])).first()
    assert blast["callers"] == 3


def test_text(spark):
    src = [("a.py", 1, "@app.get('/users/{id}/')"), ("a.py", 2, "# WHY: it is so"), ("b.ts", 1, "axios.get('http://h/users/:id')"), ("a.py", 3, "eval(x)")]
    lines = spark.createDataFrame(src, "file string, line long, text string")
    found = text.contracts(lines, names.language(F.col("file"))).withColumn("repo", F.col("file"))
    assert {x["contract_id"] for x in found.collect()} == {"http::GET::/users/{param}"}
    assert [tuple(x) for x in text.contract_links(found).collect()] == [("http::GET::/users/{param}", "a.py", "b.ts", 0.95)]
    assert [tuple(x) for x in text.markers(lines).collect()] == [("a.py", 2, "WHY", "it is so")]
    assert [x["kind"] for x in text.pattern_scan(lines, text.SECURITY, F.substring_index("file", ".", -1)).collect()] == ["eval_call"]
    assert text.grep(lines, "eval(", fixed=True).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg" / "m.py").write_text("import os\n\nclass A(B):\n    'Doc.'\n    def f(self):\n        return g(1)\n")
    (tmp_path / "node_modules" / "x.py").write_text("a = 1\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (\n")
    files = config.source_files(spark, str(tmp_path), ("py",))
    entities, refs = config.parse_python(files)
    assert {(x["name"], x["kind"], x["parent"]) for x in entities.collect()} == {("A", "class", None), ("f", "method", "A")}
    assert {(x["name"], x["kind"], x["caller"]) for x in refs.collect()} == {("os", "import", None), ("g", "call", "A.f")}
    config.write_jsonl(entities, str(tmp_path / "out"))
    assert config.read_entities(spark, str(tmp_path / "out")).count() == 2
    md = spark.createDataFrame([("r.md", "# A\n```\n# no\n```\n## B ##")], "file string, text string")
    assert [(x["name"], x["level"], x["line"]) for x in config.markdown_sections(md).orderBy("line").collect()] == [("A", 1, 1), ("B", 2, 5)]


def rows(pdf):
    cell = lambda x: "" if x is None or (isinstance(x, float) and math.isnan(x)) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in pdf[sorted(pdf.columns)].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(db.execute(catalog.ORACLES[name]).df())
