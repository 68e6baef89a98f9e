"""Toxicity by Levenshtein automata over a lexicon trie, with context windows (operator 9)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.chunks import checkpoint
from lodestone.llm.labelled import buffers, held_out, logistic, sample

#: Labelled documents that lexicon and weights are fitted on, at most.
SAMPLE = 8000
#: Different words that a term follows in toxic documents, at least.
SUPPORT = 5
#: Terms of at least so many characters are also found with one edit.
FUZZY = 5
#: Words on either side of a hit that are its context.
CONTEXT = 12
#: A hit between quotation marks counts so much.
QUOTED = 0.2
#: A hit counts so much more for each other hit in its context, three at most.
COMPANY = 0.25
#: Lengths of the stems that may enter the lexicon.
STEMS = range(4, 9)

#: Characters beyond this are letters.
_LAST = 0x2FFF
_LETTER = np.array([chr(c).isalnum() for c in range(_LAST)] + [True])
_INNER = np.zeros(128, dtype=bool)
_INNER[list(b"@$*!'")] = True
_MARKS = ['"', "“", "”", "„", "«", "»"]


def characters(texts: list[bytes]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts in lower case, each with a line end after it, as one string and as code points, and where each text ends."""
    low = [t.decode("utf-8", "replace").lower() for t in texts]
    joined = "\n".join([*low, ""])
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4"), np.cumsum([len(t) + 1 for t in low]) - 1


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters and digits; one sign between two of them, as in a masked word, doesn't end a run."""
    letter = _LETTER[np.minimum(points, _LAST)]
    inside = letter.copy()
    inside[1:-1] |= _INNER[np.minimum(points[1:-1], 127)] & letter[:-2] & letter[2:]
    edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@dataclass
class Automaton:
    """A deterministic automaton over characters. next[state, class of character]; state 0 is dead, 1 the start. The class of
    letters[i], which ascend, is i + 1, of any other character 0.

    result[state] is 0, or 1 + 2 * term + edits for a word that ends here; sinks accept whatever follows (stems)."""

    letters: np.ndarray
    next: np.ndarray
    result: np.ndarray
    sink: np.ndarray

    @cached_property
    def classes(self) -> np.ndarray:
        out = np.zeros(0x110000, dtype=np.int32)
        out[self.letters] = np.arange(1, len(self.letters) + 1)
        return out

    def run(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The result of every word, all words a character at a time; nearly all are dead after a few."""
        out = np.zeros(len(starts), dtype=np.int64)
        at, place, state = np.arange(len(starts)), starts.copy(), np.ones(len(starts), dtype=np.int64)
        while len(at):
            state = self.next[state, self.classes[points[place]]]
            place = place + 1
            over = (place == ends[at]) | self.sink[state]
            out[at[over]] = self.result[state[over]]
            go = ~over & (state != 0)
            at, place, state = at[go], place[go], state[go]
        return out


def compile_lexicon(terms: list[tuple[str, bool]], fuzzy: int = FUZZY) -> Automaton:
    """The trie of the terms (text, whether a stem) intersected with the Levenshtein automaton for one edit.

    A state is a set of (trie node, edits so far). Terms shorter than ``fuzzy`` characters allow no edit.
    """
    children: list[dict[str, int]] = [{}]
    word_end: dict[int, int] = {}
    stem_end: dict[int, int] = {}
    edits = [0]  # that some term below a node allows
    for t, (term, stem) in enumerate(terms):
        node, path = 0, [0]
        for c in term:
            if c not in children[node]:
                children.append({})
                edits.append(0)
                children[node][c] = len(children) - 1
            node = children[node][c]
            path.append(node)
        (stem_end if stem else word_end).setdefault(node, t)
        if len(term) >= fuzzy:
            for n in path:
                edits[n] = 1
    allowed = [int(len(term) >= fuzzy) for term, _ in terms]
    letters = sorted({c for term, _ in terms for c in term})

    def close(pairs: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e < 1 and edits[node]:
                for child in children[node].values():  # a missing character
                    if edits[child] and (child, 1) not in pairs:
                        pairs.add((child, 1))
                        todo.append((child, 1))
        return frozenset(p for p in pairs if p[1] == 0 or (p[0], 0) not in pairs)

    def step(state, c: str | None) -> frozenset[tuple[int, int]]:
        out = set()
        for node, e in state:
            if c is not None and c in children[node]:
                child = children[node][c]
                if e == 0 or edits[child]:
                    out.add((child, e))
            if e == 0 and edits[node]:
                out.add((node, 1))  # an added character
                out.update((child, 1) for child in children[node].values() if edits[child])  # another character
        return close(out)

    def best(state, ends: dict[int, int]) -> int:
        return min(((e, ends[n]) for n, e in state if n in ends and e <= allowed[ends[n]]), default=(0, -1))

    states = {frozenset(): 0}
    queue = [close({(0, 0)})]
    states[queue[0]] = 1
    table, result, sink = [[0] * (len(letters) + 1)], [0], [False]
    for state in queue:
        row = []
        e, t = best(state, stem_end)
        if t >= 0 and (e == 0 or all(x for _, x in state)):  # with an edit only if no way without one is left
            table.append([0] * (len(letters) + 1))
            result.append(1 + 2 * t + e)
            sink.append(True)
            continue
        e, t = best(state, word_end)
        result.append(0 if t < 0 else 1 + 2 * t + e)
        sink.append(False)
        for c in [None, *letters]:
            to = step(state, c)
            if to not in states:
                states[to] = len(states)
                queue.append(to)
            row.append(states[to])
        table.append(row)
    return Automaton(np.array([ord(c) for c in letters]), np.array(table, dtype=np.int32), np.array(result, dtype=np.int64), np.array(sink))


@dataclass
class Model:
    """weight[1 + 2 * term + edits]; slope and bias of the logistic curve over log(1 + the document's sum)."""

    automaton: Automaton | None
    weight: np.ndarray
    slope: float
    bias: float

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every hit the document, the result and the weight of its context."""
        if self.automaton is None or not texts:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        joined, points, ends_of = characters(texts)
        starts, ends = words_of(points)
        result = self.automaton.run(points, starts, ends)
        at = np.flatnonzero(self.weight[result] > 0)
        doc = np.searchsorted(ends_of, starts[at], side="left")
        first = np.searchsorted(starts, np.concatenate(([0], ends_of[:-1])))
        last = np.append(first[1:], len(starts)) - 1
        # a context ends where its document does
        low_hit = np.maximum(np.searchsorted(at, at - CONTEXT), np.searchsorted(doc, doc))
        high_hit = np.minimum(np.searchsorted(at, at + CONTEXT, side="right"), np.searchsorted(doc, doc, side="right"))
        near = np.minimum(3, high_hit - low_hit - 1)
        context = 1 + COMPANY * near
        for i, (k, d) in enumerate(zip(at.tolist(), doc.tolist())):
            a, b = starts[max(first[d], k - CONTEXT)], ends[min(last[d], k + CONTEXT)]
            a, b = max(a - 1, 0), min(b + 1, ends_of[d])  # marks touch words
            if any(m in joined[a : starts[k]] for m in _MARKS) and any(m in joined[ends[k] : b] for m in _MARKS):
                context[i] = QUOTED
        return doc, result[at], context

    def sums(self, texts: list[bytes]) -> np.ndarray:
        doc, result, context = self.hits(texts)
        return np.bincount(doc, self.weight[result] * context, minlength=len(texts)).astype(float)  # integers if there is no hit

    def score(self, texts: list[bytes]) -> np.ndarray:
        return logistic(self.slope * np.log1p(self.sums(texts)) + self.bias)


def _beginnings(word: str) -> set[str]:
    """The word, with a space at its end, and its beginnings."""
    return ({word + " "} if len(word) > 3 else set()) | {word[:n] for n in STEMS if len(word) >= n}


_CANDIDATE = pa.schema([("term", pa.string()), ("after", pa.int64())])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word of a document and every beginning of one, once, with the word before it."""
    for b, texts in buffers(batches, 1):
        for text in texts:
            found: dict[str, int] = {}
            before = ""
            joined, points, _ = characters([text])
            for a, e in zip(*(x.tolist() for x in words_of(points))):
                w = joined[a:e]
                for c in _beginnings(w):
                    found.setdefault(c, zlib.crc32(before.encode("utf-8", "replace")))
                before = w
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=_CANDIDATE)


def choose_terms(found: dict[str, tuple[int, int]]) -> list[tuple[str, bool]]:
    """From candidates that tell toxic documents, the closed ones: of a word and its beginnings in the same documents
    the longest, and nothing that a chosen stem covers. found: documents (toxic, other) of each candidate."""
    best_below: dict[str, int] = {}
    for c, (t, _) in found.items():
        for n in STEMS:
            if len(c) > n:
                best_below[c[:n]] = max(best_below.get(c[:n], 0), t)
    closed = [c for c, (t, _) in found.items() if c.endswith(" ") or best_below.get(c, 0) < 0.95 * t]
    closed.sort(key=lambda c: (len(c), c))
    chosen: list[str] = []
    stems: set[str] = set()
    for c in closed:
        if not any(c[:n] in stems for n in STEMS if n < len(c)):
            chosen.append(c)
            if not c.endswith(" "):
                stems.add(c)
    chosen.sort(key=lambda c: (-found[c][0], c))
    return [(c.rstrip(" "), not c.endswith(" ")) for c in chosen]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and weights from at most ``most`` labelled documents (labelled.sample).

    A candidate enters the lexicon if in toxic documents it follows SUPPORT different words (so copies of a text don't
    count), and is there at least 100 times as frequent as elsewhere. Both are tested on the executors, for every
    candidate; what passes is collected, all of it (the sample bounds it). A term's weight, and another for its misspellings, is the logarithm of its odds, in units
    of the strongest; a misspelling that isn't found starts from half of its term's. Without toxic labels nothing
    is toxic.
    """
    chosen = checkpoint(sample(docs, labels, label, most, id_col, text_col))
    totals = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    nothing = Model(None, np.zeros(1), 0.0, -4.0)
    if not toxic:
        return nothing
    by_term = chosen.where("y = 1").select("id", "text").mapInArrow(_candidates, "term string, after long").groupBy("term", "after").agg(F.count("*").alias("t"))
    by_term = by_term.groupBy("term").agg(F.sum("t").alias("t"), F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
    other = chosen.where("y = 0").select("id", "text").mapInArrow(_candidates, "term string, after long").groupBy("term").agg(F.count("*").alias("o"))
    told = by_term.join(other, "term", "left").select("term", "t", F.coalesce("o", F.lit(0)).alias("o")).where(F.col("t") * (clean + 1) >= F.col("o") * (100 * (toxic + 1)))
    terms = choose_terms({r["term"]: (r["t"], r["o"]) for r in told.collect()})
    if not terms:
        return nothing
    size = 1 + 2 * len(terms)
    first = Model(compile_lexicon(terms), np.concatenate(([0.0], np.ones(size - 1))), 1.0, 0.0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in buffers(batches, 1):
            doc, result, _ = first.hits(texts)
            found = [np.unique(result[doc == i]).tolist() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(2).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], schema=pa.schema([("y", pa.int32()), ("result", pa.list_(pa.int32()))]))

    seen = chosen.select("id", "text", "y").mapInArrow(look, "y int, result array<int>").select("y", F.explode("result").alias("r"))
    t, o = np.zeros(size), np.zeros(size)
    for r in seen.groupBy("r").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o")).collect():
        t[r["r"]], o[r["r"]] = r["t"], r["o"]
    odds = lambda t, o: np.log(((t + 0.5) / (toxic + 1)) / ((o + 0.5) / (clean + 1)))
    weight = np.zeros(size)
    weight[1::2] = np.maximum(0, odds(t[1::2], o[1::2]))
    found = t[2::2] + o[2::2]
    weight[2::2] = np.where(found > 0, np.clip(odds(t[2::2], o[2::2]) - 2, 0, weight[1::2]), weight[1::2] / 2)
    weight /= max(weight.max(), 1e-9)
    second = Model(first.automaton, weight, 1.0, 0.0)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in buffers(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(2).cast(pa.int32()), pa.array(second.sums(texts), pa.float64())], schema=pa.schema([("y", pa.int32()), ("x", pa.float64())]))

    got = chosen.select("id", "text", "y").mapInArrow(total, "y int, x double").toPandas()
    y, x = got["y"].to_numpy(float), np.log1p(got["x"].to_numpy())
    slope, bias = _curve(x, y)
    return Model(first.automaton, weight, slope, bias)


def _curve(x: np.ndarray, y: np.ndarray, decay: float = 1e-3) -> tuple[float, float]:
    """A logistic curve through (x, y), by Newton's method with a little decay; it rises."""
    a, b = 1.0, -1.0
    for _ in range(50):
        p = logistic(a * x + b)
        g = np.array([((p - y) * x).mean() + decay * a, (p - y).mean() + decay * b])
        s = p * (1 - p)
        h = np.array([[(s * x * x).mean() + decay, (s * x).mean()], [(s * x).mean(), s.mean() + decay]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return max(float(a), 0.0), float(b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs: the chance that its text is toxic.

    Words are run through the lexicon's automaton, which also accepts one edit; the hits' weights are summed, less
    between quotation marks and more in the company of others. A null text counts as empty. Repeated rows stay,
    null ids are held out, and other columns of docs are not looked at.
    """
    model = train(docs, labels, "toxic", SAMPLE, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in buffers(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(texts), pa.float64())], schema=schema)

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, unchanged."""
    model = train(docs, labels, "toxic", SAMPLE, id_col, text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.schema.get_field_index(text_col)
            for part, texts in buffers(iter([b]), text):
                yield part.filter(pa.array(model.score(texts) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, learning from labels.toxic."""
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
