"""Best-fit-decreasing packing of tokenised documents into sequences (operator 7)."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.chunks import checkpoint

#: Ends every document.
END_ID = 1
SEQUENCE = 4096
#: Pieces whose ids a worker keeps.
KEPT_WORDS = 1_000_000
#: Characters of a text that are split into words at once.
SLICE = 1 << 20
#: White space for str.split() but not for the tokenizer's pattern.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"\s")

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII and Latin letters that have one form only. In a text of these the tokenizer's pieces are found by re.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
_LETTER = "a-z\u00df-\u00f6\u00f8-\u017f"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s{_LETTER}0-9]+")


class Ids:
    """Ids of texts as little-endian 32-bit values.

    The tokenizer cuts a text into pieces, never across white space, and encodes each by itself, so the ids of a
    piece are looked up once and kept. Texts of plain Latin letters are cut here (checked against the tokenizer in
    the tests); in others the words between white space are given to it as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _at_once(self, pieces: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):
            return self._one_by_one(pieces)
        data, at = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *at], at)]

    def _look_up(self, parts: list[str], kept: dict[str, bytes], learn) -> bytes:
        if new := list(set(parts).difference(kept)):
            if len(kept) > KEPT_WORDS:
                kept.clear()
                new = list(set(parts))
            kept.update(zip(new, learn(new)))
        return b"".join(map(kept.__getitem__, parts))

    def slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            cut = _SPACE.search(text, at + SLICE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def of(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self._look_up(_PIECE.findall(text.lower()), self.pieces, self._at_once)
        if _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self._look_up(text.split(), self.words, self._one_by_one)


_IDS: dict[str, Ids] = {}


def _ids(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's tokens cut into pieces of at most ``size``; (part, nth): a number of its own among pieces of this length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, part, seen = _ids(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = b"".join(ids.of(s) for s in ids.slices(text or "")) + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    cut = data[at : at + 4 * size]
                    n = len(cut) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(cut), part, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 7, _PIECES)], schema=_PIECES)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _PIECES_DDL)


class OpenBins:
    """Open bins by remaining capacity: ranges of bin numbers for each capacity, and a segment tree over the capacities."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(self, capacity: int, low: int, high: int) -> None:
        if high > low and capacity > 0:
            self.ranges[capacity].append((low, high))
            i = capacity + self.leaves
            while i and not self.any[i]:
                self.any[i] = True
                i //= 2

    def take(self, capacity: int) -> tuple[int, int]:
        out = self.ranges[capacity].pop()
        if not self.ranges[capacity]:
            i = capacity + self.leaves
            self.any[i] = False
            while i > 1:
                i //= 2
                self.any[i] = self.any[2 * i] or self.any[2 * i + 1]
        return out

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that an open bin has."""
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Packs counts[length] pieces of each length; bins hold ``size``. Longest first, each into the fullest bin that takes it.

    Pieces of one length are alike, and so are bins of one remaining capacity, so they are placed together: rows
    (length, first, bin, each, offset) say that the pieces of this length numbered from ``first`` to the next row's
    go ``each`` to a bin, into bins numbered from ``bin``, one after the other from ``offset``.
    """
    bins, opened, plan = OpenBins(size), 0, []
    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        while left:
            capacity = bins.tightest(length)
            if capacity is None:
                capacity, each = size, size // length
                low, high = opened, opened + -(-left // each)
                opened = high
            else:
                each = capacity // length
                low, high = bins.take(capacity)
            full = min(high - low, left // each)
            if full:
                plan.append((length, first, low, each, size - capacity))
                bins.put(capacity - each * length, low, low + full)
                first, left, low = first + full * each, left - full * each, low + full
            if 0 < left < each and low < high:
                plan.append((length, first, low, left, size - capacity))
                bins.put(capacity - left * length, low, low + 1)
                left, low = 0, low + 1
            bins.put(capacity, low, high)
    return plan


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the tokens of all docs into few sequences of at most ``size`` tokens.

    Returns for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset. Only documents longer
    than ``size`` are cut. A null or empty text is the end token alone; rows with equal or null ids are documents of
    their own. Other columns of docs are not looked at.

    The driver sees how many pieces have each length, at most ``size`` numbers, and returns a plan for lengths, of a
    size that depends on ``size`` and not on the documents; the pieces look up their places in it.
    """
    cut = checkpoint(pieces(docs, tokenizer or default_tokenizer(), size, id_col, text_col))
    counts = checkpoint(cut.groupBy("length", "part").count())
    plan = best_fit_decreasing({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, size)
    base = counts.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("base"))
    rows = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    keys = (rows[:, 0] << 44) | rows[:, 1]
    schema = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, nth = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 44) | nth, side="right") - 1
            _, first, low, each, offset = rows[at].T
            ahead = nth - first
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(low + ahead // each), pa.array(offset + ahead % each * length)], schema=schema)

    numbered = cut.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("nth"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
