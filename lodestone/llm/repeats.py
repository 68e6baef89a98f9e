"""Windows of tokens that occur again: the engine below substring dedup (words) and suffix-array dedup (bytes).

Tokens of all texts are compared window by window without a row for each window. Each window belongs to its
minimiser (see arrays.anchors), about one position in seven or fourteen; windows are equal only below equal
minimisers. So the texts are ordered by ever longer digits, as a most-significant-digit radix sort of the suffixes
does, and only groups of equals go on:

1. ``shared``: the minimiser's k-gram alone. Those that only one document has are done with (bytes only; for words
   the next step is cheap enough).
2. ``stretches``: all tokens that the windows of one minimiser cover. Where every occurrence of a k-gram has the same
   stretch, its windows are settled at once.
3. ``windows``: the whole window, token by token, only below k-grams that occur in different stretches.

Each step is a question of the chunks to hash buckets (see chunks.py): a chunk sends each key once with its least
(document, start), and gets back the least of all. Keys hold 112 bits or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import arrays as A
from lodestone.llm import chunks as C
from lodestone.llm.arrays import U64

_S_BITS = U64((1 << 48) - 1)
_SHORT = U64((1 << 40) - 1)
_SIGN = U64(1 << 63)
NOTHING = np.zeros(0, dtype=U64)


@dataclass(frozen=True)
class Windows:
    """What is compared. tokens: 'bytes' or 'words'; window: tokens in a window; k: tokens in a minimiser;
    within: whether an earlier start in the same document counts."""

    tokens: str
    window: int
    k: int
    within: bool


class Chunk:
    """The documents of one chunk, their tokens and the minimisers of all their windows."""

    def __init__(self, blob: bytes, spec: Windows, find: bool = True):
        self.spec = spec
        self.ids, self.texts = C.load(blob)
        # ids in unsigned order; a missing id comes last
        self.order = np.array([C.NO_ID if i is None else i for i in self.ids], dtype=np.int64).view(U64) ^ _SIGN
        sizes = np.array([len(t or b"") for t in self.texts], dtype=np.int64)
        sep = b"\n" if spec.tokens == "words" else b""
        self.buf = np.frombuffer(sep.join(t or b"" for t in self.texts), dtype=np.uint8)
        self.byte0 = np.cumsum(sizes + len(sep)) - sizes - len(sep)
        if spec.tokens == "words":
            self.starts, self.ends = A.word_spans(self.buf)
            self.first = np.searchsorted(self.starts, self.byte0)
            self.counts = np.diff(np.concatenate((self.first, [len(self.starts)])))
            self.hashes = A.word_hashes(self.buf, self.starts, self.ends)
        else:
            self.first, self.counts = self.byte0, sizes
        if not find:
            return
        self.groups = []
        for spans in A.segments(self.counts, spec.window):
            x = np.concatenate([self._tokens(self.first[d] + o, n) for d, o, n in spans])
            self.groups.append(A.anchors(x, spans, spec.window, spec.k))
        get = lambda name, kind: np.concatenate([g[name] for g in self.groups]) if self.groups else np.zeros(0, kind)
        self.h, self.s = get("h", U64), get("s", U64) & _S_BITS
        self.doc, self.start, self.count = get("doc", np.int64), get("start", np.int64), get("count", np.int64)
        self.d = self.order[self.doc]
        self.p = self.start.astype(U64) if spec.within else np.zeros(len(self.start), U64)

    def _tokens(self, at: int, n: int) -> np.ndarray:
        return self.hashes[at : at + n] if self.spec.tokens == "words" else A.BYTE[self.buf[at : at + n]]

    def windows(self, below: np.ndarray) -> tuple[np.ndarray, ...]:
        """All windows of the marked minimisers: h, hash of the window, order of the document, start (0 if it doesn't count), document, start."""
        out, at = [], 0
        for g in self.groups:
            mine = below[at : at + len(g["h"])]
            at += len(g["h"])
            if not mine.any():
                continue
            place, owner = A.spread(g["at"][mine], g["count"][mine])
            start = g["start"][mine][owner] + place - g["at"][mine][owner]
            doc = g["doc"][mine][owner]
            out.append((g["h"][mine][owner], A.window_hashes(g["r"], place, self.spec.window, self.spec.k), self.order[doc], start.astype(U64) if self.spec.within else np.zeros(len(start), U64), doc, start))
        if not out:
            return (NOTHING,) * 4 + (np.zeros(0, np.int64),) * 2
        h, w, *rest = (np.concatenate(c) for c in zip(*out))
        return h, w & _S_BITS, *rest


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of x are among ``of``, which is sorted."""
    if not len(of):
        return np.zeros(len(x), dtype=bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def before(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(a, b) < (c, d)"""
    return (a < c) | ((a == c) & (b < d))


def split_answers(n: int, who: np.ndarray, keep: np.ndarray, columns: list[np.ndarray]) -> list[bytes | None]:
    """The kept rows, which are sorted, packed for each of the n chunks that asked."""
    rows = np.flatnonzero(keep)
    rows = rows[np.argsort(who[rows], kind="stable")]
    ends = np.searchsorted(who[rows], np.arange(n + 1))
    return [A.pack(*(c[rows[a:b]] for c in columns)) if b > a else None for a, b in zip(ends, ends[1:])]


def short(h: np.ndarray) -> np.ndarray:
    """Enough of a hash to tell k-grams of one bucket apart nearly always."""
    return h & _SHORT


def shared(chunks: DataFrame, spec: Windows, n: int) -> DataFrame:
    """Answers: the (short) k-grams of the chunk's minimisers that occur in two chunks, or in two documents of one.

    This only keeps unique k-grams out of the next step, so one that gets through by chance does no harm.
    """

    def emit(row):
        c = Chunk(row["docs"], spec)
        h = short(c.h)
        o = np.lexsort((c.d, h))
        h, d = h[o], c.d[o]
        first = A.starts_of_groups(h)
        last = np.concatenate((first[1:], [len(h)])) - 1
        h, many = h[first], (d[first] != d[last]) if len(h) else np.zeros(0, bool)
        return C.split_by_bucket(row["chunk"], n, h, lambda at: A.pack(h[at[~many[at]]], h[at[many[at]]]))

    def reduce(ids, blobs):
        parts = [A.unpack(b) for b in blobs]
        who = np.repeat(np.arange(len(parts)), [len(p[0]) + len(p[1]) for p in parts])
        h = np.concatenate([x for p in parts for x in p])
        many = np.concatenate([x for p in parts for x in (np.zeros(len(p[0]), bool), np.ones(len(p[1]), bool))])
        o = np.argsort(h)
        h, who, many = h[o], who[o], many[o]
        first = A.starts_of_groups(h)
        size = np.diff(np.concatenate((first, [len(h)])))
        hit = (size > 1) | np.logical_or.reduceat(many, first)
        return split_answers(len(parts), who, np.repeat(hit, size), [h])

    return C.answer(C.ask(chunks, emit), reduce)


def least(h: np.ndarray, s: np.ndarray, d: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """One row for each (h, s), with its least (d, p), sorted."""
    o = np.lexsort((p, d, s, h))
    h, s, d, p = h[o], s[o], d[o], p[o]
    first = A.starts_of_groups(h, s)
    return [h[first], s[first], d[first], p[first]]


def asked_stretches(chunks: DataFrame, spec: Windows, n: int, among: str | None = None) -> DataFrame:
    """Each chunk's (k-gram, stretch) with its least (document, start); among: the column with the answers of shared()."""

    def emit(row):
        c = Chunk(row["docs"], spec)
        h, s, d, p = c.h, c.s, c.d, c.p
        if among:
            keep = member(short(h), np.sort(np.concatenate([A.unpack(b)[0] for b in row[among] or ()] or [NOTHING])))
            h, s, d, p = h[keep], s[keep], d[keep], p[keep]
        cols = least(h, s, d, p)
        return C.split_by_bucket(row["chunk"], n, cols[0], lambda at: A.pack(*(x[at] for x in cols)))

    return C.ask(chunks, emit)


def settle_stretches(ids: list, blobs: list, old: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[bytes | None], np.ndarray]:
    """Answers to asked_stretches(), for one bucket: columns h, s, least document and start of all, and 1 if the k-gram occurs
    in different stretches (then only the windows tell); rows that say nothing new are left out. old: k-grams and
    stretches of earlier batches, which come before all. Also returns which k-grams of old are in question."""
    (h, s, d, p), who = A.concat(blobs, 4)
    if old is not None:
        h, s = np.concatenate((h, old[0])), np.concatenate((s, old[1]))
        zero = np.zeros(len(old[0]), U64)
        d, p, who = np.concatenate((d, zero)), np.concatenate((p, zero)), np.concatenate((who, np.full(len(zero), len(blobs))))
    o, group, first = A.group_minima([h, s, d, p], 2)
    h, s, d, p, who = h[o], s[o], d[o], p[o], who[o]
    at = A.starts_of_groups(h)
    size = np.diff(np.concatenate((at, [len(h)])))
    unclear = np.repeat(group[at + size - 1] > group[at], size) if len(h) else np.zeros(0, bool)
    if old is not None and len(h):  # of no interest unless the new batch has it
        unclear &= np.repeat(np.minimum.reduceat(who, at) < len(blobs), size)
    keep = unclear | before(d[first], p[first], d, p)
    out = split_answers(len(blobs), who, keep, [h, s, d[first], p[first], unclear.astype(U64)])
    return out, np.unique(h[unclear & (who == len(blobs))])


def settled(c: Chunk, answers) -> tuple[np.ndarray, np.ndarray]:
    """Of the chunk's minimisers: those whose whole stretch occurs earlier, and the others whose windows must be compared.

    A window's first occurrence is never in a stretch that occurs earlier, so the settled ones need not be compared."""
    got = [A.unpack(b) for b in answers or ()]
    answered = np.sort(np.concatenate([g[0] for g in got] or [NOTHING]))
    o = np.sort(c.h)
    at = np.flatnonzero(member(c.h, answered) | member(c.h, o[1:][o[1:] == o[:-1]]))
    hit = np.zeros(len(c.h), dtype=bool)
    hit[at[repeated(c.h[at], c.s[at], c.d[at], c.p[at], [g[:4] for g in got])]] = True
    vague = np.unique(np.concatenate([g[0][g[4] == 1] for g in got] or [NOTHING]))
    return hit, member(c.h, vague) & ~hit


def asked_windows(chunks: DataFrame, spec: Windows, n: int, column: str, old: str | None = None) -> DataFrame:
    """Each chunk's windows in question with their least (document, start). old: a boolean column, true for chunks that come before all others."""

    def emit(row):
        if not row[column]:
            return iter(())
        c = Chunk(row["docs"], spec)
        h, w, d, p, _, _ = c.windows(settled(c, row[column])[1])
        if old and row[old]:
            d, p = np.zeros(len(d), U64), np.zeros(len(p), U64)
        cols = least(h, w, d, p)
        return C.split_by_bucket(row["chunk"], n, cols[0] ^ cols[1], lambda at: A.pack(*(x[at] for x in cols)))

    return C.ask(chunks, emit)


def settle_windows(ids: list, blobs: list) -> list[bytes | None]:
    """Answers to asked_windows(): h, window, least document and start of all, where another chunk has a lesser one."""
    (h, w, d, p), who = A.concat(blobs, 4)
    o, _, first = A.group_minima([h, w, d, p], 2)
    h, w, d, p, who = h[o], w[o], d[o], p[o], who[o]
    return split_answers(len(blobs), who, before(d[first], p[first], d, p), [h, w, d[first], p[first]])


def repeated(h, s, d, p, more: list[list[np.ndarray]]) -> np.ndarray:
    """Which rows have the same (h, s) as a row with a lesser (d, p), among themselves or more."""
    n = len(h)
    cols = [np.concatenate([own] + [m[i] for m in more]) for i, own in enumerate((h, s, d, p))]
    o, _, first = A.group_minima(cols, 2)
    d, p = cols[2][o], cols[3][o]
    out = np.zeros(len(o), dtype=bool)
    out[o] = before(d[first], p[first], d, p)
    return out[:n]


def covered(row: dict, spec: Windows, stretches: str, windows: str) -> tuple[Chunk, list[np.ndarray | None]]:
    """The chunk, and for each document which tokens lie in a window that occurs earlier (None: no token)."""
    c = Chunk(row["docs"], spec)
    hit, open_ = settled(c, row[stretches])
    doc, start, count = c.doc[hit], c.start[hit], c.count[hit]
    h, w, d, p, wdoc, wstart = c.windows(open_)
    hit = repeated(h, w, d, p, [A.unpack(b) for b in row[windows] or ()])
    doc, start = np.concatenate((doc, wdoc[hit])), np.concatenate((start, wstart[hit]))
    count = np.concatenate((count, np.ones(int(hit.sum()), np.int64)))
    out: list[np.ndarray | None] = [None] * len(c.ids)
    o = np.argsort(doc, kind="stable")
    for part in np.split(o, A.starts_of_groups(doc[o])[1:]) if len(o) else ():
        k = int(doc[part[0]])
        edge = np.zeros(int(c.counts[k]) + 1, dtype=np.int32)
        np.add.at(edge, start[part], 1)
        np.add.at(edge, start[part] + count[part] - 1 + spec.window, -1)
        out[k] = np.cumsum(edge[:-1]) > 0
    return c, out


def finish(chunks: DataFrame, schema: pa.Schema, ddl: str, make: Callable[[dict], list[list]]) -> DataFrame:
    """make(row of chunks) gives the columns of the result for a chunk's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cols = make(b.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return chunks.mapInArrow(run, ddl)
