"""Rows that once gave wrong answers or stopped an operator."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import arrays, components, itq_dedup, katz, mixing, nn_descent, quality, substring_dedup, toxicity
from lodestone.llm.chunks import checkpoint

DOCS = "doc_id long, text string"


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n)), "".join("ba"[i.bit_count() % 2] for i in range(n))


def test_words_that_defeat_polynomial_hashes(spark):
    a, b = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(20))
    got = substring_dedup.substring_dedup(spark.createDataFrame([(1, f"{a} {rest[:-4]}"), (2, f"{b} {rest[:-4]}")], DOCS)).collect()
    assert [r["n_removed"] for r in got] == [0, 0]
    got = {r["doc_id"]: r["n_known"] for r in katz.katz_scores(spark.createDataFrame([(1, a), (2, b)], DOCS), lambda ids: np.array([i == 1 for i in ids])).collect()}
    assert got == {1: 2, 2: 1}


def test_word_hashes_of_any_length():
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.integers(33, 36, n, dtype=np.uint8)) for n in range(1, 200) for _ in range(20)})
    buf = np.frombuffer(b" ".join(words + words), np.uint8)
    h = arrays.word_hashes(buf, *arrays.word_spans(buf))
    assert len(np.unique(h)) == len(words) and (h[: len(words)] == h[len(words) :]).all()


def off(rows):
    """How many words each source is off its target, its shortest document that has words, and the target."""
    out = {}
    for r in rows:
        source = r["source_size"], r["target"]
        taken, _, short = out.get(source, (0, 0, 10**9))
        out[source] = taken + r["taken"], r["target"], min(short, r["size"] or 10**9)
    return [(abs(taken - target), short, target) for taken, target, short in out.values()]


def test_mixing_splits_equal_rows(spark):
    rows = [(7, "five words are in here", "a")] * 300 + [(8, "w " * 1100, "b"), (None, "of no id", "b"), (None, "of no id", "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert len(got) == 303 and all(gap < max(short, 5) for gap, short, _ in off([r for r in got if r["source_size"] == 1500]))
    assert {r["copies"] for r in got if r["doc_id"] == 7} in ({0, 1}, {1}, {0})


def test_mixing_comes_near_with_fifty_documents_a_source(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert all(gap < 0.01 * target for gap, _, target in off(got))


def one_edit(a, b):
    """0, 1 or 2 (more): how many characters to add, drop or change."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return 1 if a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:] else 2


def test_toxicity_score_against_a_plain_search():
    terms = ["idiot", "schwachkopf", "débile", "scum"]
    weight = np.array([0.0, 1.0, 0.4, 0.9, 0.3, 0.8, 0.2, 0.7, 0.0])
    m = toxicity.Model(toxicity.compile_lexicon([(t, False) for t in terms]), weight, 2.0, -1.5)
    rng = np.random.default_rng(9)
    pool = ["idiot", "Idiot", "idoot", "schwachkopf", "schwächkopf", "débile", "debile", "scum", "scam", "word", "another", "Ärger", "x1", "\"idiot\"", "“scum”"]
    texts = ["", "\n", "idiot"] + [" ".join(rng.choice(pool, int(rng.integers(1, 60)), p=[0.02] * 9 + [0.195] * 4 + [0.02] * 2)) for _ in range(60)]
    want = []
    for t in texts:
        low = t.lower()
        words = [(w[0], w.start(), w.end()) for w in re.finditer(r"[^\W_]+", low)]
        hits = []
        for k, (w, _, _) in enumerate(words):
            found = min(((e, i) for i, x in enumerate(terms) if (e := one_edit(w, x)) == 0 or e == 1 and len(x) >= toxicity.FUZZY), default=None)
            if found and weight[1 + 2 * found[1] + found[0]] > 0:
                hits.append((k, weight[1 + 2 * found[1] + found[0]]))
        total = 0
        for k, x in hits:
            near = sum(abs(k - o) <= toxicity.CONTEXT for o, _ in hits) - 1
            a, b = words[max(0, k - toxicity.CONTEXT)][1] - 1, words[min(len(words) - 1, k + toxicity.CONTEXT)][2] + 1
            quoted = any(q in low[max(a, 0) : words[k][1]] for q in '"“”') and any(q in low[words[k][2] : b] for q in '"“”')
            total += x * (toxicity.QUOTED if quoted else 1 + toxicity.COMPANY * min(3, near))
        want.append(1 / (1 + math.exp(-(2.0 * math.log1p(total) - 1.5))))
    assert np.allclose(m.score([t.encode() for t in texts]), want)


def lengths(case):
    rng = np.random.default_rng(12)
    if case == "ties":
        return np.eye(700)
    x = rng.normal(size=(2000, 12))
    x[77] *= {"one long": 1e6, "very long": 1e150}[case]
    return x


@pytest.mark.parametrize("case", ["ties", "one long", "very long"])
def test_nearest_of_ties_and_of_very_long_vectors(spark, case):
    x = lengths(case)
    n = len(x)
    df = spark.createDataFrame([(i, v, 5) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, o int")
    got = {}
    for r in nn_descent.nearest(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert sorted(got) == list(range(0, n, 100))
    hit = 0
    for q, rows in got.items():
        assert [r[0] for r in sorted(rows)] == list(range(1, 21)) and [r[1:] for r in sorted(rows)] == sorted(r[1:] for r in rows)
        s = x @ x[q]
        s[q] = -np.inf
        hit += sum(-d >= np.sort(s)[-20] * (1 - 1e-12) for _, d, _ in rows)
    assert hit >= 0.95 * 20 * len(got)


@pytest.mark.parametrize("rows", [10_000, 1_000_000, 4_000_000])
def test_tables_find_pairs_at_the_threshold(rows):
    """Pairs at a cosine of exactly 0.95, the hardest that link, in tables as wide as those of so many rows."""
    rng = np.random.default_rng(6)
    d, (width, number) = 64, itq_dedup.table_shape(rows, 0.95)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a = unit(rng.normal(size=(3000, d)))
    w = rng.normal(size=a.shape)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * unit(w - (w * a).sum(axis=1)[:, None] * a)
    turns = [itq_dedup.itq(a, seed) for seed in range(-(-width * number // d))]
    x, y = (itq_dedup.table_keys(np.hstack([(v - m) @ t > 0 for m, t in turns]).astype(np.int64), width, number) for v in (a, b))
    assert (x == y).any(axis=1).mean() >= 0.99


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "LEAST", 3)
    monkeypatch.setattr(components, "SHARE", 10)
    rng = np.random.default_rng(3)
    edges = [(5000, int(i)) for i in rng.permutation(2000)[:900]] + [(7000, int(i)) for i in range(3000, 3400)] + [(int(a), int(a) + 1) for a in range(4000, 4040)] + [(7000, 4010)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: top(x) for x in list(root)}


def test_factorisation_machine_against_every_pair():
    rng = np.random.default_rng(4)
    m, size = 6, 40
    fm = quality.FactorisationMachine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)), None, None)
    x = rng.normal(size=(m, size)) * (rng.random((m, size)) < 0.4)
    d, j = np.nonzero(x)
    want = [0.3 + fm.w @ r + sum(fm.v[a] @ fm.v[b] * r[a] * r[b] for a in range(size) for b in range(a)) for r in x]
    assert np.allclose(fm.raw(d, j, x[d, j], m)[0], want)


def test_components_that_are_settled_take_no_round(spark, monkeypatch):
    """Each round costs many tasks, and so the driver's listeners much; a round that only finds that nothing changes is left out."""
    written = []
    monkeypatch.setattr(components, "checkpoint", lambda df: written.append(1) or checkpoint(df))
    stars = [(k, k // 10 * 10) for k in range(50)] + [(60, 61), (61, 60), (None, 1)]
    for edges, most in ((stars, 1), ([(k, k + 1) for k in range(4)], 3), ([(1, 1)], 1)):
        written.clear()
        got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
        assert got == ({k: k // 10 * 10 for k in range(50)} | {60: 60, 61: 60} if edges is stars else dict.fromkeys(range(5), 0) if len(edges) > 1 else {})
        assert len(written) <= most
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def made(spark, run):
    """What run() returns, and the most rows that the joins and generators of one kind made, in all plans that it executed."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: [e.executionId() for e in map(store.executionsList().apply, range(store.executionsCount()))]
    before = set(ids())
    out = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    counts = {}
    for k in set(ids()) - before:
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if re.search("Join|Generate", node.name()):
                for m in map(node.metrics().apply, range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        kind = re.sub(r"#\d+L?", "", node.desc())
                        counts[kind] = counts.get(kind, 0) + int(values.apply(m.accumulatorId()).replace(",", ""))
    return out, max(counts.values(), default=0)


@pytest.mark.parametrize("least", [500, 3])
def test_components_make_a_row_for_an_edge(spark, monkeypatch, least):
    """No step doubles the edges or computes them twice: a few large groups, each tied by several forests, with hubs dealt out and without."""
    monkeypatch.setattr(components, "LEAST", least)
    rng = np.random.default_rng(8)
    edges = {(max(a, b), min(a, b)) for n in (600, 90) for _ in range(4) for a, b in ((1000 * n + k, 1000 * n + int(rng.integers(0, 1 + k // 50))) for k in range(1, n)) if a != b}
    got, most = made(spark, lambda: dict(map(tuple, components.connected_components(spark.createDataFrame(sorted(edges), "a long, b long").repartition(3)).collect())))
    assert got == {1000 * n + k: 1000 * n for n in (600, 90) for k in range(n)}
    assert 0 < most <= 3 * len(edges), (most, len(edges))
