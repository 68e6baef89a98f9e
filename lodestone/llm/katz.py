"""Language-model scoring: a Katz backoff model over words (operator 8).

The model's tables are partitioned by hash and live in the buckets that chunks ask (see chunks.py): how often each
word, pair and longer gram occurs in the training documents, and what each context leaves to words that never follow
it. Nothing of the size of the vocabulary is broadcast or collected; a chunk is told the counts of its own grams, in
the order in which it asked, and evaluates its tokens from the lowest order up.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import arrays as A
from lodestone.llm import chunks as C
from lodestone.llm.arrays import U64

#: Words of the longest gram.
ORDER = 3
#: Bytes of text in a chunk: the larger, the fewer distinct grams are asked for all told.
CHUNK_BYTES = 4 << 20
#: Of a key a bucket gets the leading 48 bits, which the bucket's number adds to.
_SHORT, _KEY = U64(16), U64((1 << 48) - 1)
#: Counts above this are not discounted.
GT_MAX = 5
#: A context whose discounts free no more has freed nothing: what is left is rounding.
NOTHING = 1e-11
#: Keeps a quotient finite; what is left in a lower order is never less.
SMALL = 1e-15
NONE = np.zeros(0, dtype=np.int64)
_END = A.mix(np.array([0x5EED], dtype=U64))[0]
_START = A.mix(np.array([0x57A7], dtype=U64))[0]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def default_training(ids: list) -> np.ndarray:
    """Which documents are learnt from: crc32 of the id as text, modulo 7, is not 2. A null id counts as an empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i in ids], dtype=bool)


def good_turing(of_count: dict[int, int], most: int = GT_MAX) -> np.ndarray:
    """Katz's discount ratios d[1..most] from how many types occur 1, 2, ... most + 1 times; where the estimate makes no sense half an
    event is taken off, so that some mass is freed all the same. Without types that occur once all are 1."""
    d = np.ones(most + 2)
    n = [0, *(of_count.get(r, 0) for r in range(1, most + 2))]
    if n[1] == 0:
        return d
    a = (most + 1) * n[most + 1] / n[1]
    for r in range(1, most + 1):
        d[r] = 1 - 0.5 / r
        if n[r] and a < 1:
            x = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
            if 0 < x < 1:
                d[r] = x
    return d


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return count * d[np.minimum(count, len(d) - 1).astype(np.int64)]


class Text:
    """A chunk's tokens: every document's words and an end, and for each order the distinct grams.

    gram[k], of order k + 1: the number of each token's gram among keys[k], which are sorted by bucket and hash (as
    ``place`` has them). context[k]: the number of the gram of order k + 1 before each token, or, at a document's
    start, one more than the last. at[k]: for each distinct gram a token where it ends.
    """

    def __init__(self, blob: bytes, training: Callable[[list], np.ndarray], order: int, n: int):
        self.ids, texts = C.load(blob)
        self.train = training(self.ids)
        buf = _LOWER[np.frombuffer(b"\n".join(t or b"" for t in texts), dtype=np.uint8)]
        sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
        starts, ends = A.word_spans(buf)
        words = A.word_hashes(buf, starts, ends)
        at = np.searchsorted(starts, np.cumsum(sizes))  # an end goes after each document's words
        tokens = np.insert(words, at, _END)
        self.n = np.diff(np.concatenate(([0], at))) + 1
        self.doc = np.repeat(np.arange(len(self.ids)), self.n)
        self.in_train = self.train[self.doc]
        first = np.cumsum(self.n) - self.n
        self.place, self.gram, self.context, self.at = [], [], [], []
        hashed = tokens
        for _ in range(order):
            code, keys = pd.factorize(hashed)
            place = (bucket_of(keys, n) << U64(48)) | (keys >> _SHORT)
            by = np.argsort(place)
            rank = np.empty(len(by), dtype=np.int64)
            rank[by] = np.arange(len(by))
            code = rank[code]
            some = np.empty(len(by), dtype=np.int64)
            some[code] = np.arange(len(code))
            before = np.concatenate(([0], code[:-1]))
            before[first] = len(by)
            self.place.append(place[by])
            self.gram.append(code)
            self.context.append(before)
            self.at.append(some)
            before = np.concatenate(([_START], hashed[:-1]))
            before[first] = _START
            hashed = A.mix(before * U64(3)) + tokens

    def counts(self, k: int) -> np.ndarray:
        """How often each distinct gram of order k + 1 occurs in the chunk's training documents."""
        return np.bincount(self.gram[k][self.in_train], minlength=len(self.place[k])).astype(U64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(32)) % U64(n)


#: Where a document's start is in the tables of contexts: under the number that follows the last bucket's grams.
def start_of(k: int, n: int) -> np.ndarray:
    key = A.mix(np.array([0x57A7 + k + 1], dtype=U64))
    return (bucket_of(key, n) << U64(48)) | (key >> _SHORT)


def by_bucket(chunk: int, columns: list[tuple[np.ndarray, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """A row of ASK for each bucket: of every (places, columns aligned with them) its part, keys first. Places are sorted."""
    found = np.unique(np.concatenate([np.unique(p >> U64(48)) for p, _ in columns]))
    if not len(found):
        return
    cuts = [(np.searchsorted(p, found << U64(48)), np.searchsorted(p, (found + U64(1)) << U64(48))) for p, _ in columns]
    blobs = []
    for i in range(len(found)):
        part = []
        for (p, rest), (a, b) in zip(columns, cuts):
            part += [p[a[i] : b[i]] & _KEY, *(c[a[i] : b[i]] for c in rest)]
        blobs.append(A.pack(*part))
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.full(len(found), chunk, np.int64)), pa.array(blobs, pa.binary())], schema=C.ASK)


def told(row, name: str, columns: int) -> list[np.ndarray]:
    """The buckets' answers in the order of the places asked for."""
    parts = [A.unpack(g["blob"]) for g in sorted(row[name] or [], key=lambda g: g["bucket"])]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, U64) for i in range(columns)]


def answered(asked: DataFrame, reduce: Callable[[list[list[np.ndarray]]], tuple[list, list | None]]) -> DataFrame:
    """(chunk, bucket, blob, stats): reduce(a bucket's rows of ASK, unpacked) gives for each of them columns or None, and a
    short vector about the bucket, kept with its first row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, about = reduce([A.unpack(b) for b in pdf["blob"]])
        keep = [i for i, o in enumerate(out) if o is not None]
        blobs = pd.Series([A.pack(*out[i]) for i in keep], dtype=object)
        stats = pd.Series([about if i == 0 else None for i in range(len(keep))], dtype=object)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[keep].to_numpy(), "bucket": pdf["bucket"].iloc[keep].to_numpy(), "blob": blobs, "stats": stats})

    return asked.groupBy("bucket").applyInPandas(run, "chunk long, bucket int, blob binary, stats array<long>")


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    """For each key of each chunk twice the sum of its counts, plus one for the first chunk that counted it; and of the
    distinct keys the sum of counts, how many have any, and how many have 1, 2, ... GT_MAX + 1."""
    count = np.concatenate(counts).astype(np.int64)
    code, distinct = pd.factorize(np.concatenate(keys))
    total = np.bincount(code, count, minlength=len(distinct)).astype(np.int64)
    some = np.flatnonzero(count)[::-1]
    speaker = np.full(len(distinct), -1)
    speaker[code[some]] = some
    out = 2 * total[code]
    out[speaker[speaker >= 0]] += 1
    of = np.bincount(np.minimum(total, GT_MAX + 2), minlength=GT_MAX + 3)
    return np.split(out, np.cumsum([len(k) for k in keys])[:-1]), [int(total.sum()), int((total > 0).sum()), *of[1 : GT_MAX + 2].tolist()]


def katz_scores(docs: DataFrame, training: Callable[[list], np.ndarray] = default_training, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Scores every text under a Katz model of the training documents, with grams of up to ``order`` words.

    After a context v of one or more words, P(w | v) = d(c) c(v w) / c(v) for a gram that occurs, with Good-Turing
    ratios d for c up to GT_MAX (one set for each order), else alpha(v) P(w | v without its first word). P(w) is Katz
    again: d(c) c(w) / N, and the mass that this frees goes to words that training doesn't have (taken as one).
    alpha(v) makes the probabilities after v sum to 1 exactly: it is what the discounts of v's grams free, over the
    lower-order probability of the words that never follow v. A context that training doesn't have backs off in full.
    Where the discounts free nothing (all of v's grams are too frequent for one), one more event is taken as seen:
    P(w | v) = c(v w) / (c(v) + 1), and the rest is for the others. The first words follow a start.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (see the contract: base is
    add-one over words; score log10 of the model's probability). Null and empty texts are an end alone. Null ids are
    hashed as an empty text; repeated rows count each time. Without any training token base and score are 0 and
    the uniform 0 of one unseen word.
    """
    chunks = C.make_chunks(docs, id_col, text_col, CHUNK_BYTES)
    n = min(C.buckets(chunks, CHUNK_BYTES), (1 << 16) - 1)  # a place has 16 bits for it

    # 1. counts of all grams; of the chunks that have one in training one is told that it speaks for it
    def ask_grams(row):
        t = Text(row["docs"], training, order, n)
        return by_bucket(row["chunk"], [(t.place[k], [t.counts(k)]) for k in range(order)])

    def count(parts):
        got = [summed([p[2 * k] for p in parts], [p[2 * k + 1] for p in parts]) for k in range(order)]
        return [list(cols) for cols in zip(*(g[0] for g in got))], [x for g in got for x in g[1]]

    grams = C.checkpoint(answered(C.ask(chunks, ask_grams), count))
    about = _totals(grams, order)
    N, V = about[0][:2]
    d = [good_turing(dict(enumerate(a[2:], 1))) for a in about]
    of = about[0][2:]
    seen_mass = sum(of_r * r * x for r, of_r, x in zip(range(1, GT_MAX + 1), of, d[0][1:])) + N - sum(r * x for r, x in zip(range(1, GT_MAX + 1), of))
    unseen = max(0.0, 1 - seen_mass / N) if N else 1.0
    if unseen <= NOTHING and N:
        unseen = 1 / (N + 1)
    per_event = (1 - unseen) / seen_mass if N else 1.0

    def with_told(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
        got = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias(name))
        return chunks.join(got.hint("shuffle_merge"), "chunk", "left")

    known = with_told(chunks, grams, "grams")

    def counts_of(row) -> tuple[Text, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """The chunk; and by order the counts of its distinct grams, which it speaks for, and how often each token's context occurs."""
        t = Text(row["docs"], training, order, n)
        got = told(row, "grams", order)
        count, mine = [(g >> U64(1)).astype(np.float64) for g in got], [(g & U64(1)) == 1 for g in got]
        # a document has one end, so it starts as often as there are ends
        starts = float(count[0][t.gram[0][t.n[0] - 1]])
        return t, count, mine, [np.append(count[k], starts)[t.context[k]] for k in range(order - 1)]

    def open_contexts(t: Text, count: list[np.ndarray], context: list[np.ndarray]) -> list[np.ndarray]:
        """By order the numbers of the contexts of which the chunk must know what they leave."""
        out: list[np.ndarray] = [NONE] * (order - 1)
        below = np.zeros(len(t.doc), dtype=bool)
        for k in reversed(range(order - 1)):
            c = count[k + 1][t.gram[k + 1]]
            whole = (c > 0) & (discounted(c, d[k + 1]) == c)  # perhaps the context has nothing but such
            ask = (context[k] > 0) & ((c == 0) | whole | below)
            out[k] = np.unique(t.context[k][ask])
            below = (context[k] > 0) & (c == 0)  # what is left after a context depends on the next shorter one
        return out

    # 2. contexts: the mass of their grams, and of these grams without their first word; every gram is sent once, with both counts
    def ask_contexts(row):
        t, count, mine, context = counts_of(row)
        asked = open_contexts(t, count, context)
        columns = []
        for k in range(order - 1):
            place = np.append(t.place[k], start_of(k, n))
            at = t.at[k + 1][mine[k + 1]]
            of = place[t.context[k][at]]
            by = np.argsort(of)
            columns += [(of[by], [count[k + 1][mine[k + 1]][by].astype(U64), count[k][t.gram[k][at]][by].astype(U64)]), (np.sort(place[asked[k]]), [])]
        return by_bucket(row["chunk"], columns)

    def weigh(parts):
        out: list[list[np.ndarray]] = [[] for _ in parts]
        for k in range(order - 1):
            keys, long, short, asked = ([p[4 * k + i] for p in parts] for i in range(4))
            code, distinct = pd.factorize(np.concatenate([*keys, *asked]))
            given = sum(map(len, keys))
            sums = [np.bincount(code[:given], discounted(np.concatenate(c).astype(np.float64), d[j]), minlength=len(distinct)) for c, j in ((long, k + 1), (short, k))]
            places = np.split(code[given:], np.cumsum([len(a) for a in asked])[:-1])
            for o, p in zip(out, places):
                o += [_bits(s[p]) for s in sums]
        return [o if any(map(len, o)) else None for o in out], None

    contexts = C.checkpoint(answered(C.ask(known, ask_contexts), weigh))

    # 3. the texts, from the lowest order up
    def score(row):
        t, count, _, context = counts_of(row)
        asked = open_contexts(t, count, context)
        got = told(row, "contexts", 2 * (order - 1))
        word = count[0][t.gram[0]]
        p = np.where(word > 0, discounted(word, d[0]) * per_event, unseen)
        share = np.full(len(t.doc), per_event)  # of an event, in the order below
        for k in range(order - 1):
            place = np.append(t.place[k], start_of(k, n))
            by = np.argsort(place[asked[k]])
            mass, lower = (np.zeros(len(place)) for _ in range(2))
            mass[asked[k][by]], lower[asked[k][by]] = _floats(got[2 * k]), _floats(got[2 * k + 1])
            mass, lower, total = mass[t.context[k]], lower[t.context[k]], np.maximum(context[k], 1)
            c = count[k + 1][t.gram[k + 1]]
            full = (mass > 0) & (total - mass <= NOTHING * total)
            own = np.where(full, 1 / (total + 1), 1 / total)
            left = np.where(full, own, 1 - mass * own)
            alpha = np.where(context[k] > 0, left / np.maximum(1 - lower * share, SMALL), 1.0)
            p = np.where(c > 0, discounted(c, d[k + 1]) * own, alpha * p)
            share = own
        m = len(t.ids)
        base = np.log10((word + 1) / (N + V + 1))
        return [t.ids, ~t.train, t.n, np.bincount(t.doc, word > 0, minlength=m).astype(np.int64), np.full(m, N, np.int64), _exact(base, t.n), _exact(np.log10(p), t.n)]

    from lodestone.llm.repeats import finish

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return finish(with_told(known, contexts, "contexts"), schema, ddl, score)


def _exact(x: np.ndarray, sizes: np.ndarray) -> list[float]:
    """The correctly rounded sum of each document's values, whatever the order of its tokens."""
    ends = np.cumsum(sizes)
    return [math.fsum(x[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist())]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.float64).view(U64)


def _floats(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.float64)


def _totals(answers: DataFrame, order: int) -> list[list[int]]:
    """By order N, V and how many types occur 1, 2, ... GT_MAX + 1 times: sums of the buckets' vectors."""
    size = GT_MAX + 3
    got = answers.where("stats is not null").agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(order * size))).first()
    got = [int(x or 0) for x in got]
    return [got[k * size : (k + 1) * size] for k in range(order)]


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents."""
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_katz": op8_katz}
ORACLES: dict[str, str] = {}
