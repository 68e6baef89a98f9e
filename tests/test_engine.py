"""Scanners, manifests, git, resolution, diffs and the engine on small inputs."""

import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine, Workspace, cluster_summary, diff_revisions, diff_texts
from lodestone.functions import names
from lodestone.operators import diff, graph, resolve
from lodestone.sources import git, manifests
from lodestone.sources import structured as S


def found(file, text):
    return {(x[1], x[2], x[3], x[4], x[5]) for x in S.scan_rows(file, text)[0]}


@pytest.mark.parametrize(
    ("file", "text", "want"),
    [
        ("a.rs", "pub struct A { x: i32 }\nimpl T for A {\n    pub fn go(&self) -> i32 { h(\"}\") }\n}\n", {("A", "class", 1, 1, None), ("go", "method", 3, 3, "A")}),
        ("a.go", "type S struct {\n\tx int\n}\nfunc (s *S) Run() {\n\tf(1)\n}\n", {("S", "class", 1, 3, None), ("Run", "method", 4, 6, "S")}),
        ("a.ts", "export class B extends C {\n  run(x: number): void {\n    if (x) { f(x) }\n  }\n}\nconst g = (y) => f(y);\n", {("B", "class", 1, 5, None), ("run", "method", 2, 4, "B"), ("g", "function", 6, 6, None)}),
        ("A.java", "public class A extends B {\n  int f(int x) {\n    return g(x);\n  }\n}\n", {("A", "class", 1, 5, None), ("f", "method", 2, 4, "A")}),
        ("a.kt", "class A(val x: Int) : B() {\n  fun go(): Int = x\n  fun two() {\n    go()\n  }\n}\n", {("A", "class", 1, 6, None), ("go", "method", 2, 2, "A"), ("two", "method", 3, 5, "A")}),
        ("a.rb", "class A < B\n  def go\n    run(1) if x\n  end\nend\n", {("A", "class", 1, 5, None), ("go", "method", 2, 4, "A")}),
        ("a.php", "<?php\nclass A extends B {\n  public function go($x) {\n    return h($x);\n  }\n}\n", {("A", "class", 2, 6, None), ("go", "method", 3, 5, "A")}),
        ("a.c", "#include \"x.h\"\nstatic int f(int a) {\n  return g(a);\n}\n", {("f", "function", 2, 4, None)}),
        ("a.cs", "namespace N {\n  public class A : B {\n    public void Go() {\n      Run();\n    }\n  }\n}\n", {("N", "module", 1, 7, None), ("A", "class", 2, 6, "N"), ("Go", "method", 3, 5, "N.A")}),
        ("a.swift", "class A: B {\n  func go() -> Int {\n    return run()\n  }\n}\n", {("A", "class", 1, 5, None), ("go", "method", 2, 4, "A")}),
        ("a.xyz", "class A {}", set()),
        ("a.rs", "", set()),
        ("a.js", "}}}{{{ class", set()),
    ],
)
def test_scan(file, text, want):
    assert found(file, text) == want


def test_data_files():
    name = lambda rows: {(x[1], x[2], x[3], x[5]) for x in rows}
    assert name(S.json_rows("a", '{\n "a": {"b": 1},\n "l": [{"id": "x"}],\n "_m": {"z": 1}\n}')) == {("a", "object", 2, None), ("b", "property", 2, "a"), ("l", "array", 3, None), ("x", "object", 3, "l"), ("id", "property", 3, "l.x"), ("_m", "derived", 4, None), ("z", "derived", 4, "_m")}
    assert {(r[1], r[5]) for r in S.yaml_rows("a", "a:\n  b: 1\n  c: !t {d: 2}\nl: [1]\n")} == {("a", None), ("b", "a"), ("c", "a"), ("d", "a.c"), ("l", None)}
    assert {(r[1], r[5]) for r in S.toml_rows("a", "[a]\nb = 1\n[a.c]\nd = [1]\n")} == {("a", None), ("b", "a"), ("c", "a"), ("d", "a.c")}
    md = name(S.markdown_rows("a", "---\nt: 1\n---\n# A\n\npara\n\n- x\n  y\n\n## B\n```py\n# no\n```\n> q\n# C\nend"))
    assert md >= {("frontmatter", "frontmatter", 1, None), ("t", "property", 2, "frontmatter"), ("A", "section", 4, None), ("B", "section", 11, "A"), ("py", "code_block", 12, "A.B"), ("> q", "blockquote", 15, "A.B"), ("C", "section", 16, None)}
    assert S.json_rows("a", "{") == S.yaml_rows("a", "a: [") == S.toml_rows("a", "=") == S.markdown_rows("a", "") == []
    entities, refs = S.component_rows("a.vue", "<template>\n <MyBox/>\n</template>\n<script lang=\"ts\">\nfunction f() {\n  g()\n}\n</script>")
    assert [e[1:5] for e in entities] == [("f", "function", 5, 7)] and [r[1:5] for r in refs] == [("f", "g", "call", 6), (None, "MyBox", "instantiation", 2)]


def test_manifests(spark):
    src = [
        ("a", "go.mod", "module x.y/a\nrequire (\n p.q/r v1 // z\n)\n"), ("a", "web/tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/*"],}}} // c'), ("b", "composer.json", '{"name": "v/b", "autoload": {"psr-4": {"App\\\\": "lib/"}}}'),
        ("b", "package.json", '{"name": "b", "dependencies": {"left": "1"}}'), ("b", "bad/package.json", "{"), ("b", "nginx.conf", "location /api/ { proxy_pass http://h/v1/; }"), ("b", ".env", "A=1\nB='2'\nA=3\n"), ("b", "docker-compose.yml", "    - A=9\n    - C=4\n"), ("c", "go.mod", None),
    ]
    files = spark.createDataFrame(src, "repo string, file string, text string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(manifests.prefixes(files)) == {("a", "go", "x.y/a", ""), ("a", "typescript", "@app", "web/src"), ("b", "php", "App", "lib")}
    assert rows(manifests.dependencies(files)) == {("a", "go.mod", "go", "p.q/r", "v1"), ("b", "package.json", "npm", "left", "1")}
    assert rows(manifests.env(files)) == {("b", "A", "1"), ("b", "B", "2"), ("b", "C", "4")}
    assert rows(manifests.proxy_rewrites(files)) == {("b", "/api/", "/v1/")}
    assert rows(manifests.canonical_names(files)) == {("a", "a"), ("b", "b"), ("c", "c"), ("a", "x.y/a"), ("b", "v/b")}
    assert manifests.bulk_members("pnpm-workspace.yaml", 'packages:\n  - "a/*"\n  - b\n') == ["a/*", "b"]
    back = resolve.rewritten(spark.createDataFrame([("/api/users",), ("/apix",), ("/api",)], "path string"), manifests.proxy_rewrites(files))
    assert rows(back) == {("/api/users", "/v1/users"), ("/apix", None), ("/api", "/v1")}


def test_git(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=n@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for n, body in ((1, "def f(a):\n    return 1\n"), (2, "def f(a, b):\n    return 1\n\n\ndef g():\n    pass\n")):
        (repo / "a.py").write_text(body)
        (repo / f"n{n}.txt").write_text("x")
        run("add", "-A")
        run("commit", "-qm", f"subject {n}\n\nbody line")
    repos = git.members(spark, str(tmp_path))
    assert {(r["repo"], r["author"], r["file"]) for r in git.commits(repos).collect()} == {("r", "n@x", "a.py"), ("r", "n@x", "n1.txt"), ("r", "n@x", "n2.txt")}
    assert {(r["subject"], r["body"], tuple(sorted(r["files"]))) for r in git.messages(repos).collect()} == {("subject 1", "body line", ("a.py", "n1.txt")), ("subject 2", "body line", ("a.py", "n2.txt"))}
    assert {(r["status"], r["file"]) for r in git.changed_files(repos, "HEAD~1..HEAD").collect()} == {("M", "a.py"), ("A", "n2.txt")}
    assert {(r["name"], r["change"], r["breaking"]) for r in diff_revisions(repos, "HEAD~1..HEAD", ("py",)).collect()} == {("f", "modified", True), ("g", "added", False)}


def test_resolution(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/m.ts",), ("src/lib/index.ts",), ("pkg/x.py",), ("pkg/sub/y.py",), ("pkg/__init__.py",)], "file string")
    imports = spark.createDataFrame([("src/a.ts", "./m"), ("src/a.ts", "./lib"), ("src/a.ts", "@app/m"), ("src/a.ts", "gone"), ("pkg/sub/y.py", "..x"), ("pkg/sub/y.py", "pkg.x")], "file string, module string")
    got = {(r["module"], r["target"]) for r in resolve.module_files(imports, files, spark.createDataFrame([("@app", "src")], "prefix string, dir string")).collect()}
    assert got == {("./m", "src/m.ts"), ("./lib", "src/lib/index.ts"), ("@app/m", "src/m.ts"), ("..x", "pkg/x.py"), ("pkg.x", "pkg/x.py")}
    e = spark.createDataFrame([("m.py", "f", "function", None), ("n.py", "g", "function", None), ("o.py", "g", "function", None), ("m.py", "go", "method", "A"), ("z.py", "go", "method", "B")], "file string, name string, kind string, parent string")
    r = spark.createDataFrame([("c.py", None, "f", "call"), ("c.py", None, "g", "call"), ("m.py", "A.run", "self.go", "call"), ("c.py", "x", "B.go", "call"), ("c.py", "x", "n.g", "call"), ("c.py", "x", "q.z", "call")], "file string, caller string, name string, kind string")
    mods = spark.createDataFrame([("c.py", t) for t in ("m.py", "n.py", "o.py")], "file string, target string")
    assert [(x["name"], x["target"]) for x in resolve.imported(r, mods, e).collect()] == [("f", "m.py")]
    assert {(x["name"], x["target"], x["how"]) for x in resolve.member_calls(r, e).collect()} == {("self.go", "m.py", "self"), ("B.go", "z.py", "unique_class"), ("n.g", "n.py", "module")}
    again = spark.createDataFrame([("c.py", "f", "index.py"), ("index.py", "f", "mid.py"), ("mid.py", "f", "m.py"), ("k.py", "w", "k2.py"), ("k2.py", "w", "k.py")], "file string, name string, origin string")
    assert [tuple(x) for x in resolve.through_barrels(again.select("file", "name").where("file in ('c.py', 'k.py')"), again, e).collect()] == [("c.py", "f", "m.py", 0.7)]
    go = resolve.by_manifest(spark.createDataFrame([("main.go", "x.y/a/util"), ("main.go", "other/p")], "file string, module string"), spark.createDataFrame([("x.y/a", ""), ("x.y", "zz")], "prefix string, dir string"), spark.createDataFrame([("util/u.go",), ("main.go",)], "file string"))
    assert [(x["module"], x["target"]) for x in go.collect()] == [("x.y/a/util", "util/u.go")]
    over = {(x["name"], x["parent"], x["other_parent"]) for x in resolve.overrides(e).collect()}
    assert over == {("go", "A", "B"), ("go", "B", "A")}
    many = spark.createDataFrame([(f"f{i}.py", "m", "method", f"C{i % 9}") for i in range(40)], "file string, name string, kind string, parent string")
    rows = sorted({(x[3], x[0]) for x in many.collect()})
    want = {(p, f, q, g) for p, f in rows for q, g in sorted(((q, g) for q, g in rows if q != p), key=lambda x: (x[1], x[0]))[:5]}
    assert {(x["parent"], x["file"], x["other_parent"], x["other_file"]) for x in resolve.overrides(many).collect()} == want
    cross = resolve.cross_repo_symbols(spark.createDataFrame([("a", "b::util::f"), ("b", "b::f")], "repo string, name string"), spark.createDataFrame([("b", "m.rs", "f"), ("b", "tests/m.rs", "f")], "repo string, file string, name string"), spark.createDataFrame([("b", "b")], "repo string, canonical string"))
    assert [tuple(x) for x in cross.collect()] == [("a", "b::util::f", "b", "m.rs", 0.9)]
    q = e.withColumn("qualified_name", F.col("name"))
    assert {(x["name"], x["file"]) for x in resolve.externals(spark.createDataFrame([("lib.f",)], "name string"), q).collect()} == {("lib.f", "m.py")}


def test_diffs(spark):
    assert diff.line_diff("a\nb", "a\nc") == [("-", 2, "b"), ("+", 2, "c")] and diff.line_diff(None, None) == [] and diff.line_diff(None, "x") == [("+", 1, "x")]
    assert diff.hunks("a\nb\nc", "a\nx\nc", 1) == " a\n-b\n+x\n c"
    assert diff.change_details("x = 1", "x = 2") == [("value_changed", "1", "2")]
    assert diff.change_details("call(alpha, b)", "call(beta, b)") == [("argument_changed", "alpha", "beta")]
    assert diff.change_details("", "fresh line") == [("line_added", "", "fresh line")]
    rows = spark.createDataFrame([("k", "x = 1", "x = 2"), ("e", None, None)], "id string, old string, new string")
    assert [tuple(r) for r in diff.token_changes(rows, ["id"]).collect()] == [("k", "value_changed", "1", "2")]
    assert [tuple(r) for r in diff.line_diffs(rows, ["id"]).collect()] == [("k", "-", 1, "x = 1"), ("k", "+", 1, "x = 2")]
    side = lambda *n: spark.createDataFrame([("function", "f", None, x) for x in n], "kind string, file string, parent string, name string")
    assert [(r["old_name"], r["new_name"]) for r in diff.fuzzy_renames(side("load_user", "zzz"), side("load_users", "qq")).collect()] == [("load_user", "load_users")]
    assert diff.fuzzy_renames(side(), side("a")).count() == 0
    c = spark.createDataFrame([("a", "X.f", "modified"), ("b", "f", "modified"), ("a", "g", "added"), ("a", "h", "added"), ("a", "i", "removed")], "file string, name string, change string")
    assert [tuple(r) for r in diff.cross_file_patterns(c).collect()] == [("modified", "f", 2, 2)]
    assert {tuple(r) for r in diff.change_groups(c).collect()} == {("a", 4, "X.f, g, h +1 more"), ("b", 1, "f")}
    changes = diff_texts(spark, "a.py", "def f(a):\n    return 1\n", "def f(a, b):\n    return 1\n")
    assert [(r["name"], r["change"], r["breaking"]) for r in changes.collect()] == [("f", "modified", True)]


def test_engine(spark, tmp_path):
    src = [("pkg/a.py", "from pkg.b import helper\n\n\nclass A:\n    def run(self):\n        return helper(1)\n"), ("pkg/b.py", "def helper(x):\n    return x\n\n\ndef unused():\n    return 2\n"), ("pkg/c.py", "from pkg.b import helper\n\n\ndef go():\n    return helper(2)\n")]
    files = spark.createDataFrame(src, "file string, text string")
    e = Engine.index(files)
    e.save(str(tmp_path / "index"))
    e = Engine(Engine.load(spark, str(tmp_path / "index")).entities, Engine.load(spark, str(tmp_path / "index")).refs, None, e.lines)
    assert {r["file"] for r in e.callers("helper").where("kind = 'call'").collect()} == {"pkg/a.py", "pkg/c.py"}
    assert [r["name"] for r in e.resolve("b.py::helper").collect()] == ["helper"] and e.resolve("a.py::helper").count() == 0
    assert [r["entity"] for r in e.grep("return x", globs=["pkg/*.py"]).collect()] == ["helper"] and e.grep("return x", globs=["*.py"]).count() == 0
    assert {r["part"] for r in e.context("helper").collect()} == {"definition", "caller"}
    assert e.map(10_000).first()["file"] == "pkg/b.py" and e.map(1).count() == 1
    assert [r["name"] for r in e.answer("where is the helper?").collect()] == ["helper"]
    assert e.ranked_callers("helper", e.rank()).count() == 4
    assert e.sql("select count(*) from entities").first()[0] == 5
    changed = Engine.index(spark.createDataFrame([*src[:1], ("pkg/b.py", "def helper(x, y):\n    return x\n\n\ndef unused():\n    return 2\n"), *src[2:]], "file string, text string"))
    top = changed.review(e).first()
    assert (top["name"], top["breaking"]) == ("helper", True) and top["impact"] > 0
    w = Workspace({"one": e, "two": changed}, disabled=["two"]).engine()
    assert {r["file"] for r in w.entities.select("file").distinct().collect()} == {"one/pkg/a.py", "one/pkg/b.py", "one/pkg/c.py"}
    cache = files.select("file", F.sha2("text", 256).alias("hash")).where("file != 'pkg/c.py'")
    again = Engine.index_again(files, cache, e.entities, e.refs)
    assert again.entities.count() == 5
    m = spark.createDataFrame([(0, "a/b/x.py", 0.1), (0, "a/b/y.py", 0.3), (0, "a/c.py", 0.3), (1, "q.py", 0.0)], "community int, file string, rank double")
    assert {tuple(r) for r in cluster_summary(m).collect()} == {(0, 3, "a/c.py", "a"), (1, 1, "q.py", "q.py")}


def test_words(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(names.sql_tables(F.lit("SELECT * FROM a.B JOIN c ON 1; INSERT INTO d VALUES (1)"))) == ["a.b", "c", "d"]
    assert one(names.env_names(F.lit("os.getenv('db_url'); process.env.PORT"))) == ["DB_URL", "PORT"]
    assert one(names.normal_body(F.lit('def f():\n    """Doc\n    x"""\n    # c\n\n    return 1  '))) == "def f():\n    return 1"
    assert one(names.is_non_source(F.lit("a/b.md"))) and not one(names.is_non_source(F.lit("a/b.py")))
    assert names.glob_regex("src/**/*.{ts,js}") == r"^src/(?:.*/)?[^/]*\.(?:ts|js)$"
    assert [(r["id"], r["component"]) for r in graph.components(spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40)], "a string, b string")).orderBy("id").collect()] == [(f"{i:03d}", "000") for i in range(41)]
