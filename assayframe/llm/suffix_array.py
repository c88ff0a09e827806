"""Exact removal of repeated byte strings by per-shard suffix arrays.

1. Minimizer runs (repeats.py) find which 200-byte windows can recur: only those whose key recurs. A run whose whole
   context recurs is settled; of the others one context for each distinct run goes on.
2. Contexts are dealt to shards by key, keys with very many distinct contexts in several parts. A task sorts each shard's
   suffixes by Larsson-Sadakane refinement in numpy and takes common prefixes, up to the window's length, by Kasai's
   rule for all contexts in step: neighbours that agree in a whole window are repeats.
3. Parts of one key are merged: each part's windows, sorted by fingerprint, are cut at fixed bounds by binary search, and
   the slices of one range are looked up in each other by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import PLAIN, byte_values, digests, gather, prefix, slices, span_hash
from .repeats import COUNT, FIRST, list_parts, minimizer_runs, remove_spans
from .spark_io import partitions, row_keys, stage

#: Bytes of a minimizer, of text in one suffix array (positions take 21 bits of a packed key), and distinct contexts of
#: a key in one part.
MINIMIZER, SHARD, PART = 100, (1 << 21) - 4096, 4000
_PAD = np.random.default_rng(7).integers(0, 256, 2048, dtype=np.uint8)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text of fewer than 2**21 bytes.

    Larsson and Sadakane: start from the order by five bytes, then sort only the groups still tied, by (own rank, rank h
    further on), doubling h.
    """
    n, bits = len(text), np.uint64(21)
    low = np.uint64((1 << 21) - 1)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    h = 5
    head = np.zeros(n, np.uint64)
    for k in range(h):
        head = head << np.uint64(8) | padded[k : n + k]
    packed = np.sort(head << bits | np.arange(n, dtype=np.uint64))
    sa = (packed & low).astype(np.int64)
    value = packed >> bits
    rank = np.empty(n, np.int64)

    def regroup(slots: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks of the sorted suffixes at the slots, whose groups begin where new is true; returns slots still tied."""
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(slots)))
        rank[sa[slots]] = np.repeat(slots[begin], size)
        return slots[np.repeat(size > 1, size)]

    new = np.ones(n, bool)
    new[1:] = value[1:] != value[:-1]
    tied = regroup(np.arange(n), new)
    while h < n and len(tied):
        own = sa[tied]
        key = rank[own].astype(np.uint64) << bits | rank[np.minimum(own + h, n - 1)].astype(np.uint64)
        packed = np.sort(key << bits | own.astype(np.uint64))
        sa[tied] = (packed & low).astype(np.int64)
        value = packed >> bits
        new = np.ones(len(tied), bool)
        new[1:] = value[1:] != value[:-1]
        tied = regroup(tied, new)
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, start: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """For every position in [start, start + count) of each chain the bytes shared with its predecessor, depth at most.

    Kasai's rule, all chains in step: the next position shares at least one byte less than this one did.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    order = np.argsort(-count, kind="stable")
    start, count = start[order], count[order]
    held = np.zeros(len(start), np.int64)
    for t in range(int(count.max(initial=0))):
        live = int(np.searchsorted(-count, -t, "left"))
        p = start[:live] + t
        q = before[p]
        h = np.maximum(held[:live] - 1, 0)
        h[q < 0] = 0
        going = np.flatnonzero(q >= 0)
        while len(going):
            a, b = p[going] + h[going], q[going] + h[going]
            fits = (h[going] < depth) & (a < n) & (b < n)
            going, a, b = going[fits], a[fits], b[fits]
            same = text[a] == text[b]
            going = going[same]
            h[going] += 1
        held[:live] = h
        out[p] = h
    return out


def shard_repeats(texts: list[bytes], count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the shard, start of each text, mask of the windows that recur in the shard).

    A text has count + window - 1 bytes. A byte that UTF-8 never has parts them, so no suffix across two equals a window.
    """
    text = np.concatenate([np.frombuffer(b"\xff".join(texts), np.uint8), np.array([0xFF], np.uint8), _PAD[: 2 * window]])
    start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)[:-1]
    sa = suffix_array(text)
    same = common_prefixes(text, sa, start, count, window)[sa] >= window
    hit = np.zeros(len(text), bool)
    hit[sa[same]] = True
    hit[sa[np.flatnonzero(same) - 1]] = True
    return text, start, hit


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


OWNER = np.dtype([("f1", "<u8"), ("f2", "<u8"), ("r1", "<i8"), ("r2", "<i8"), ("a", "<i4"), ("open", "?")])
HITS = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("a", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("cut", pa.int32()), ("windows", pa.binary())])
HITS_DDL = "r1 bigint, r2 bigint, a int, n int, key bigint, cut int, windows binary"


def contexts(rows: DataFrame, window: int) -> DataFrame:
    """The bytes under the runs that rows (r1, r2, text, asked) ask for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = list_parts(batch.column(3), "key", "a", "n", "open", "part", "parts")
            for i, j, data, bounds in slices(batch.column(2)):
                lo, hi = at[i], at[j]
                own = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                raw = data.tobytes()
                first = bounds[:-1][own] + x["a"][lo:hi]
                last = first + x["n"][lo:hi] + window - 1
                part = [raw[f:g] for f, g in zip(first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).take(pa.array(own)) for c in (0, 1)), *(pa.array(x[c][lo:hi]) for c in ("key", "a", "n", "open", "part", "parts")), pa.array(part, pa.binary())], names=["r1", "r2", "key", "a", "n", "open", "part", "parts", "bytes"])

    return rows.select("r1", "r2", "text", "asked").mapInArrow(read, "r1 bigint, r2 bigint, key bigint, a int, n int, open boolean, part int, parts int, bytes binary")


def _solve(rows: list[dict], window: int) -> Iterator[pa.RecordBatch]:
    """Hits inside one shard, and of keys with several parts the fingerprints of all windows, cut into ranges."""
    count = np.array([r["n"] for r in rows], np.int64)
    text, start, hit = shard_repeats([r["bytes"] for r in rows], count, window)
    out: dict[str, list] = {f: [] for f in HITS.names}

    def put(*values) -> None:
        for f, v in zip(HITS.names, values):
            out[f].append(v)

    for r, s in zip(rows, start.tolist()):
        if r["open"]:
            for a, n in zip(*_runs(hit[s : s + r["n"]])):
                put(r["r1"], r["r2"], r["a"] + int(a), int(n), None, None, None)
    split = [k for k, r in enumerate(rows) if r["parts"] > 1]
    if split:
        v = byte_values(text)
        p, q = prefix(v), prefix(v * v)
        for key in dict.fromkeys(rows[k]["key"] for k in split):
            own = [k for k in split if rows[k]["key"] == key]
            n = count[own]
            place = gather(np.arange(len(text)), start[own], n)
            table = np.zeros(len(place), OWNER)
            table["f1"], table["f2"] = span_hash(p, place, place + window), span_hash(q, place, place + window)
            if window > PLAIN:
                table["f2"] = digests(text, place, place + window)
            for f in ("r1", "r2", "open"):
                table[f] = np.repeat([rows[k][f] for k in own], n)
            table["a"] = place - np.repeat(start[own], n) + np.repeat([rows[k]["a"] for k in own], n)
            table = table[np.argsort(table["f1"])]
            parts = rows[own[0]]["parts"]
            bounds = np.array([(c << 64) // parts for c in range(1, parts)], np.uint64)
            cuts = np.concatenate([[0], np.searchsorted(table["f1"], bounds), [len(table)]]).astype(np.int64)
            for c in range(parts):
                if cuts[c] < cuts[c + 1]:
                    put(None, None, None, None, key, c, table[cuts[c] : cuts[c + 1]].tobytes())
    yield pa.RecordBatch.from_pydict(out, HITS)


def shard_hits(texts: DataFrame, window: int) -> DataFrame:
    """Suffix arrays over shards of whole (key, part) groups; rows of HITS."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group, head = [], 0, None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if (r["key"], r["part"]) != group:
                    group, head = (r["key"], r["part"]), len(held)
                if held and size + len(r["bytes"]) + 1 > SHARD:
                    head = head or len(held)  # a group too long for one shard is cut: its key has parts
                    yield from _solve(held[:head], window)
                    held = held[head:]
                    head, size = 0, sum(len(x["bytes"]) + 1 for x in held)
                held.append(r)
                size += len(r["bytes"]) + 1
        if held:
            yield from _solve(held, window)

    dealt = texts.repartition(partitions(texts.sparkSession), "key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(solve, HITS_DDL)


def merged_hits(slices_: DataFrame) -> DataFrame:
    """Windows of split keys that recur in another part: sorted slices of one range, looked up in each other."""

    def flush(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        seen, hit = tables[0], np.zeros(len(tables[0]), bool)
        for t in tables[1:]:
            at = np.minimum(np.searchsorted(seen["f1"], t["f1"]), len(seen) - 1)
            same = (seen["f1"][at] == t["f1"]) & (seen["f2"][at] == t["f2"])
            hit[at[same]] = True
            both, marks = np.concatenate([seen, t]), np.concatenate([hit, same])
            order = np.argsort(both["f1"], kind="stable")
            seen, hit = both[order], marks[order]
        # equal windows stand side by side: each is a hit if one of them is
        equal = np.zeros(len(seen), bool)
        equal[1:] = (seen["f1"][1:] == seen["f1"][:-1]) & (seen["f2"][1:] == seen["f2"][:-1])
        group = np.cumsum(~equal) - 1
        own = seen[(np.bincount(group, weights=hit)[group] > 0) & seen["open"]]
        none = [pa.nulls(len(own), HITS.field(f).type) for f in ("key", "cut", "windows")]
        yield pa.RecordBatch.from_arrays([*(pa.array(own[f].copy()) for f in ("r1", "r2", "a")), pa.array(np.ones(len(own), np.int32)), *none], schema=HITS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["key"], r["cut"]) != group and held:
                    yield from flush(held)
                    held = []
                group = (r["key"], r["cut"])
                held.append(np.frombuffer(r["windows"], OWNER))
        if held:
            yield from flush(held)

    dealt = slices_.repartition(partitions(slices_.sparkSession), "key", "cut").sortWithinPartitions("key", "cut")
    return dealt.mapInArrow(merge, HITS_DDL)


def repeated_windows(rows: DataFrame, window: int, part_bytes: int = SHARD // 2) -> DataFrame:
    """(r1, r2, a, n): windows of rows (r1, r2, doc_id, text) that also start anywhere else."""
    runs = minimizer_runs(rows, ["r1", "r2"], window, min(MINIMIZER, window), "byte")
    # a table of its own, so that the join deals out runs anew and can split a key that very many of them have
    keys = stage(runs.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "keys")
    found = stage(runs.join(keys, "key").selectExpr("r1", "r2", "key", "ctx", FIRST, COUNT), "runs")
    classes = stage(found.groupBy("key", "ctx", "n").agg(F.count("*").alias("c"), F.min(F.struct("r1", "r2", "a")).alias("rep")), "contexts")
    settled = found.join(classes.where("c > 1").select("key", "ctx", "n"), ["key", "ctx", "n"]).select("r1", "r2", "a", "n")
    size = F.sum(F.col("n") + window)
    mixed = classes.groupBy("key").agg(F.count("*").alias("k"), F.min("c").alias("least"), F.ceil(size / part_bytes).cast("int").alias("parts"))
    mixed = mixed.where("k > 1 and least = 1").select("key", "parts")
    asked = classes.join(mixed, "key").select("rep.*", "key", "n", F.expr("c = 1").alias("open"), F.expr("CAST(pmod(ctx, parts) AS INT)").alias("part"), "parts")
    asked = asked.groupBy("r1", "r2").agg(F.collect_list(F.struct("key", "a", "n", "open", "part", "parts")).alias("asked"))
    hits = stage(shard_hits(contexts(rows.join(asked, ["r1", "r2"]), window), window), "hits")
    merged = merged_hits(hits.where("key is not null"))
    spans = ["r1", "r2", "a", "n"]
    return settled.union(hits.where("key is null").select(*spans)).union(merged.select(*spans))


def byte_dedup(docs: DataFrame, *, window: int = 200, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = SHARD // 2) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_text (bytes), kept_sha256 for every row.

    A byte goes if a window over it also starts anywhere else, in the same text or another; windows never cross texts and
    are judged on the input. A null text is empty. Repeated rows count as often as they come, so all of a long repeated
    row goes. doc_id may be null or tied. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(*row_keys(f"`{id_col}`", f"`{text_col}`"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = remove_spans(rows, repeated_windows(rows, window, part_bytes), ["r1", "r2"], window, "byte")
    return out.withColumnRenamed("n_units", "n_bytes")
