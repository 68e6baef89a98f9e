"""Numpy kernels shared by the text operators: packing of integer columns, word and window hashing."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

U64 = np.uint64
#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+``.
WS = np.zeros(256, dtype=bool)
WS[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Positions in a block are kept in the low bits of the sort key of a window's minimum.
POS_BITS = 16
BLOCK = 1 << POS_BITS


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: A random 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a UTF-8 buffer."""
    edge = np.diff(np.concatenate(([True], WS[buf], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


#: Bytes of a word that are hashed in numpy; longer words are hashed one by one.
LONG_WORD = 64
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: eight at a time through the finaliser, which starts from the length; XXH3 for long words."""
    size = ends - starts
    out = size.astype(U64) * U64(_BASE)
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate((buf, np.zeros(8, np.uint8))), 8)
    at, done = np.flatnonzero(size <= LONG_WORD), 0
    while len(at):
        left = size[at] - done
        eight = eights[starts[at] + done].view("<u8").ravel() & _KEEP[np.minimum(left, 8)]
        out[at] = mix(out[at] ^ eight)
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return out


def pack(*columns: np.ndarray) -> bytes:
    """64-bit integer columns as bytes: a column that ascends is kept as differences, each byte plane apart as far as there is
    anything in it, then zstd."""
    parts = [struct.pack("<B", len(columns))]
    for c in columns:
        c = np.ascontiguousarray(c).view(U64) if c.dtype.itemsize == 8 else c.astype(U64)
        up = len(c) > 1 and bool((c[1:] >= c[:-1]).all())
        if up:
            c = np.concatenate((c[:1], c[1:] - c[:-1]))
        planes = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        parts += [struct.pack("<QBB", len(c), up, planes), c.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns that pack() was given, as uint64."""
    raw = zstandard.ZstdDecompressor().decompress(bytes(blob))
    n, at, out = raw[0], 1, []
    for _ in range(n):
        size, up, planes = struct.unpack_from("<QBB", raw, at)
        at += 10
        c = np.zeros((size, 8), np.uint8)
        c[:, :planes] = np.frombuffer(raw, np.uint8, size * planes, at).reshape(planes, size).T
        c = c.view(U64).ravel()
        out.append(np.cumsum(c, dtype=U64) if up else c)
        at += size * planes
    return out


def concat(blobs, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of many blobs on end, and for each row the number of its blob."""
    parts = [unpack(b) for b in blobs]
    cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, U64) for i in range(width)]
    return cols, np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])


def kgrams(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of x[i:i+k] for each i, by doubling."""
    acc, span, cur, size = None, 0, x, 1
    while True:
        if k & size:
            if acc is None:
                acc, span = cur, size
            else:
                n = len(x) - span - size + 1
                acc = acc[:n] * U64(pow(_BASE, size, 1 << 64)) + cur[span : span + n]
                span += size
        if span == k:
            return acc
        n = len(cur) - size
        cur = cur[:n] * U64(pow(_BASE, size, 1 << 64)) + cur[size : size + n]
        size *= 2


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """The least of key[i:i+w] for each i."""
    cur, size = key, 1
    while size * 2 <= w:
        cur = np.minimum(cur[: len(cur) - size], cur[size:])
        size *= 2
    rest = w - size
    return np.minimum(cur[: len(cur) - rest], cur[rest:]) if rest else cur


def segments(lengths: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, first token, tokens) of at most BLOCK tokens; a longer document comes in pieces that overlap by window - 1, so each window is in one piece."""
    group: list[tuple[int, int, int]] = []
    total = 0
    for d, n in enumerate(lengths.tolist()):
        if n < window:
            continue
        at = 0
        while n - at >= window:
            take = min(n - at, BLOCK)
            if total + take > BLOCK:
                yield group
                group, total = [], 0
            group.append((d, at, take))
            total += take
            at += take - window + 1
    if group:
        yield group


def anchors(x: np.ndarray, spans: list[tuple[int, int, int]], window: int, k: int) -> dict[str, np.ndarray]:
    """The minimiser of every window of the pieces that lie in x end to end.

    A window's minimiser is the leftmost of its k-grams with the least hash. Equal windows have equal minimisers at
    equal places, so windows need comparing only under the same minimiser. Returns for each minimiser occurrence its
    hash h, the document and the document's token number at which the first of its windows starts, how many windows
    it has (they start at consecutive tokens), s: a hash of all tokens that these windows cover and of where the
    minimiser lies in them; and at, the first window's place in x, with r, the hashes that window_hashes() needs.
    """
    r = mix(kgrams(x, k))
    key = (r >> U64(POS_BITS)) << U64(POS_BITS)
    key |= np.arange(len(r), dtype=U64)
    low = (sliding_min(key, window - k + 1) & U64(BLOCK - 1)).astype(np.int64)
    first = np.cumsum([0] + [n for _, _, n in spans])
    valid = np.ones(len(low), dtype=bool)
    for e in first[1:-1].tolist():
        valid[max(0, e - window + 1) : e] = False
    p = np.flatnonzero(valid)
    a = low[p]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1))))
    lo, hi = p[new], p[np.concatenate((new[1:], [len(p)])) - 1]
    piece = np.searchsorted(first, lo, side="right") - 1
    at = a[new]
    s = mix(window_hashes(r, lo, window, k) * U64(3) + mix(window_hashes(r, hi, window, k) + ((hi - lo) * 4096 + (at - lo)).astype(U64)))
    shift = np.array([o - f for (_, o, _), f in zip(spans, first)], dtype=np.int64)
    doc = np.array([d for d, _, _ in spans], dtype=np.int64)[piece]
    return {"h": r[at], "s": s, "doc": doc, "start": lo + shift[piece], "count": hi - lo + 1, "at": lo, "r": r}


def window_hashes(r: np.ndarray, at: np.ndarray, window: int, k: int) -> np.ndarray:
    """A hash of the window that starts at each of at, from the hashes r of the k-grams that cover it."""
    out = np.zeros(len(at), dtype=U64)
    for i, o in enumerate(sorted({*range(0, window - k, k), window - k})):
        out = mix(out * U64(5) + r[at + o] + U64(i))
    return out


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[i], first[i] + 1, ... count[i] numbers for each i, and the i of each."""
    owner = np.repeat(np.arange(len(first)), count)
    skip = np.cumsum(count) - count
    return np.arange(len(owner)) - skip[owner] + first[owner], owner


def starts_of_groups(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def group_minima(order: list[np.ndarray], keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts rows by the columns; the first ``keys`` name a group, so that its first row is its least.

    Returns the order, and for each sorted row the number of its group and the place of its group's first row.
    """
    o = np.lexsort(order[::-1])
    starts = starts_of_groups(*(c[o] for c in order[:keys]))
    size = np.diff(np.concatenate((starts, [len(o)])))
    return o, np.repeat(np.arange(len(starts)), size), np.repeat(starts, size)
