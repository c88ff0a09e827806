"""Ragged numpy views of Arrow text batches, used inside Spark tasks.

Texts are taken as UTF-8 bytes straight from the Arrow buffers. A slice holds whole texts of
about ``SLICE`` bytes together, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
#: Bytes up to which a span is told apart by a polynomial hash; two different strings of letters need 1,024 to be unsafe.
PLAIN = 300
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
M1, M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
#: ASCII white space: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> U(33))
    x *= M1
    x ^= x >> U(33)
    x *= M2
    x ^= x >> U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept for the next call."""
    if not _pow or len(_pow["up"]) < n:
        size = max(n, SLICE + 64)
        for name, b in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _pow[name] = np.cumprod(p)
    return _pow["up"][:n], _pow["down"][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, one longer than values; see span_hash."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) under the prefix sums p; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64) * M2)


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of whole texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type) and not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    off = np.frombuffer(off, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space, and for each text the index of its first word (one longer)."""
    ink = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=ink[1:-1])
    begins = ink[1:-1] & ~ink[:-2]
    ends = ink[1:-1] & ~ink[2:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = ink[1:-1][inner]
    ends[inner - 1] = ink[1:-1][inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, bounds)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic digest of each span of bytes."""
    raw = data.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(start.tolist(), end.tolist())], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes. A sum modulo 2**64 cannot tell some long strings of two letters apart, so spans of more
    than PLAIN bytes take a digest."""
    h = span_hash(prefix(_BYTE[data]), start, end)
    far = np.flatnonzero(end - start > PLAIN)
    if len(far):
        h[far] = digests(data, start[far], end[far])
    return h


def same_spans(data: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[start : start + length] and other[other_start : other_start + length] agree, for each span."""
    total = int(length.sum())
    differ = np.zeros(total + 1, np.int64)
    np.cumsum(gather(data, start, length) != gather(other, other_start, length), out=differ[1:])
    stop = np.cumsum(length)
    return differ[stop] == differ[stop - length]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, len(x) - w + 1 values (none if x is shorter)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    if w == 1:
        return x
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def super_runs(values: np.ndarray, bounds: np.ndarray, window: int, k: int, data: np.ndarray | None = None):
    """Runs of neighbouring windows that share their first least k-gram, the super-k-mers of minimizer bucketing.

    Returns (text, first window, number of windows, key, context hash) of each run, windows counted from the text's
    start. The key is the k-gram's hash: equal windows have equal keys, and two equal windows are never in one run. A
    context is all that the run's windows cover. data: the bytes, if the values stand for bytes.
    """
    p = prefix(values)
    n = len(values) - window + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e
    at = np.arange(len(values) - k + 1)
    gram = span_hash(p, at, at + k)
    key = sliding_min(gram, window - k + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    good = np.arange(n) + window <= bounds[1:][text]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (gram[: n - 1] == key[:-1])
    new &= good
    first = np.flatnonzero(new)
    if not len(first):
        e = np.zeros(0, np.int64)
        return e, e, e, e, e
    stop = np.minimum(np.append(first[1:], n), np.maximum(bounds[1:][text[first]] - window + 1, 0))
    count = stop - first
    stop = first + count + window - 1
    ctx = span_hash(p, first, stop)
    far = np.flatnonzero(stop - first > PLAIN)
    if data is not None and len(far):
        ctx[far] = digests(data, first[far], stop[far])
    t = text[first]
    return t, first - bounds[:-1][t], count, key[first].view(np.int64), ctx.view(np.int64)


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The spans values[start : start + length] one behind another."""
    total = int(length.sum())
    skip = np.cumsum(length) - length
    return values[np.arange(total) - np.repeat(skip - start, length)]


def cover(starts: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
    """Mask of n places, true where a span [start, start + width) lies."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(starts + width, n), minlength=n + 1)[: n + 1]
    return np.cumsum(d[:-1]) > 0
