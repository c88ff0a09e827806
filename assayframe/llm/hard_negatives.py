"""Hard negatives from labelled vectors by a multiway hyperplane tree (GNAT).

A node of the tree has split points; a row belongs to the subtree of its nearest one. For every two split points i and j
the node stores the range of the distances from i to all rows in the subtree of j, and for every subtree the range of its
rows' norms. A query asks for the best scores (inner products) inside a window. With the norms a window of scores is an
annulus of distances around the query; by the triangle inequality the ranges bound the distances of a subtree's rows, and a
sibling whose bounds miss the annulus is eliminated. Leaves are scored exactly, so results are exact.

1. The upper tree is fitted on a sample of at most SAMPLE rows; its leaves are regions. Every row is routed to its region,
   rows are shuffled by region, and packed into blocks of one region, each with a tree of its own. A region that holds a
   third of all rows is dealt to many tasks and is many blocks. The ranges of the upper tree are those of all rows.
2. Anchors search their own region first, then, with the bounds found there, all regions that are not eliminated: chunks of
   anchors meet the blocks of a region in a join whose keys are split by the number of blocks. In a block, a node that
   eliminates less than half is scored as one leaf.
3. This is done for the positives, and then for the windows of negatives that the positives' scores open.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark_io import scratch, stage

#: Rows on which the upper tree is fitted, its split points a node, rows of a block, and rows of a leaf.
SAMPLE, FANOUT, BLOCK, LEAF = 8192, 16, 4096, 128
#: Split points of a node inside a block; rows that a task holds before it packs its fullest region; blocks' worth of rows
#: of a region that one task packs.
INNER, HELD, DEALT = 8, 32_768, 16
#: Anchors of a chunk, and blocks and chunks that one key of the join brings together at most.
CHUNK, SPREAD = 1024, 64
OPEN, UNPARTED = 1 << 53, 0.8
#: Between vectors with square norms under EXACT, floats give exact scores; rows that are scored at once; the share of
#: queries and subtrees left from which on a node inside a block is scored whole.
EXACT, STRIP, WHOLE = 1 << 24, 512, 0.5


# ---- trees: a leaf is (start, stop), a node (points, square norms of these, subtrees, lows, highs, norm lows, norm highs)
def distances(x: np.ndarray, norms: np.ndarray, points: np.ndarray, point_norms: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(norms[:, None] + point_norms - 2 * (x @ points.T), 0))


def split_points(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows far from each other among 3 k random ones (fewer if there are no more distinct ones)."""
    some = x[np.random.default_rng(seed).choice(len(x), min(len(x), 3 * k), replace=False)]
    norms = np.einsum("ij,ij->i", some, some)
    chosen, far = [0], distances(some, norms, some[:1], norms[:1])[:, 0]
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(some, norms, some[chosen[-1:]], norms[chosen[-1:]])[:, 0])
    return some[chosen]


def grow(x: np.ndarray, rows: np.ndarray, k: int, enough: int, order: list[np.ndarray], seed: int = 0):
    """Tree over x[rows] with up to k split points a node, no more than it takes for leaves of enough rows; order gets the
    leaves' rows. Rows that split points hardly part (over UNPARTED of them stay
    together, as copies do) form one leaf, so a tree is never deep."""
    at = sum(map(len, order))
    points = split_points(x[rows], min(k, -(-len(rows) // enough)), seed) if len(rows) > enough else x[:0]
    if len(points) < 2:
        order.append(rows)
        return at, at + len(rows)
    own = x[rows]
    norms, point_norms = np.einsum("ij,ij->i", own, own), np.einsum("ij,ij->i", points, points)
    d = distances(own, norms, points, point_norms)
    home = d.argmin(axis=1)
    if np.bincount(home).max() > UNPARTED * len(rows):
        order.append(rows)
        return at, at + len(rows)
    subtrees = [grow(x, rows[home == j], k, enough, order, seed * k + j + 1) for j in range(len(points))]
    low = np.stack([d[home == j].min(axis=0) for j in range(len(points))], axis=1)
    high = np.stack([d[home == j].max(axis=0) for j in range(len(points))], axis=1)
    ends = [(norms[home == j].min(), norms[home == j].max()) for j in range(len(points))]
    return points, point_norms, subtrees, low, high, np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


def span(tree) -> tuple[int, int]:
    """The rows of all leaves, which follow each other."""
    first = last = tree
    while len(first) > 2:
        first = first[2][0]
    while len(last) > 2:
        last = last[2][-1]
    return first[0], last[1]


def packed(x: np.ndarray) -> bytes:
    """Vectors of whole numbers, in two bytes a component where floats give exact scores, else as doubles."""
    return x.astype(np.int16 if np.einsum("ij,ij->i", x, x).max(initial=0) < EXACT else np.float64).tobytes()


def unpacked(cell: bytes, n: int, dim: int) -> np.ndarray:
    """Vectors as floats or doubles."""
    if len(cell) == 2 * n * dim:
        return np.frombuffer(cell, np.int16).reshape(n, dim).astype(np.float32)
    return np.frombuffer(cell).reshape(n, dim)


def regions(tree, first: int = 0) -> tuple[object, int]:
    """The tree with its leaves numbered, and their number so far."""
    if len(tree) == 2:
        return (first, first + 1), first + 1
    kids = []
    for kid in tree[2]:
        kid, first = regions(kid, first)
        kids.append(kid)
    return (*tree[:2], kids, *tree[3:]), first


def depth_of(tree) -> int:
    return 0 if len(tree) == 2 else 1 + max(map(depth_of, tree[2]))


def route(tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Region of each row, and its distances to the split points on its way, (rows, levels, FANOUT), nan where there is none."""
    out = np.full((len(x), max(1, depth_of(tree)), FANOUT), np.nan)
    region = np.zeros(len(x), np.int64)
    norms = np.einsum("ij,ij->i", x, x)
    todo = [(tree, np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        if len(node) == 2:
            region[rows] = node[0]
        elif len(rows):
            d = distances(x[rows], norms[rows], node[0], node[1])
            out[rows, level, : d.shape[1]] = d
            home = d.argmin(axis=1)
            todo += [(kid, rows[home == j], level + 1) for j, kid in enumerate(node[2])]
    return region, out


def with_ranges(tree, ranges: dict[int, tuple], level: int = 0):
    """The upper tree with the ranges of all rows: ranges has each region's (lows, highs, least and greatest norm)."""

    def leaves(node) -> list[int]:
        return [node[0]] if len(node) == 2 else [r for kid in node[2] for r in leaves(kid)]

    if len(tree) == 2:
        return tree
    k = len(tree[0])
    low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    norm_low, norm_high = np.full(k, np.inf), np.full(k, -np.inf)
    for j, kid in enumerate(tree[2]):
        for r in leaves(kid):
            if r in ranges:
                near, far, least, most = ranges[r]
                low[:, j], high[:, j] = np.minimum(low[:, j], near[level, :k]), np.maximum(high[:, j], far[level, :k])
                norm_low[j], norm_high[j] = min(norm_low[j], least), max(norm_high[j], most)
    return tree[0], tree[1], [with_ranges(kid, ranges, level + 1) for kid in tree[2]], low, high, norm_low, norm_high


class Search:
    """Queries with windows of scores, and the best rows found so far inside each (best first, ties by id)."""

    def __init__(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.q, self.low, self.high, self.k = q, low, high, k
        self.norms = np.einsum("ij,ij->i", q, q)
        self.scores = np.full((*low.shape, k), -np.inf)
        self.ids = np.zeros((*low.shape, k), np.int64)

    def least(self, rows: np.ndarray) -> np.ndarray:
        """Scores from which on a row still counts, by query and window."""
        return np.maximum(self.low[rows], self.scores[rows, :, -1])

    def walk(self, tree, rows: np.ndarray, leaf, whole: float = np.inf) -> None:
        """leaf(start, stop, queries) for all leaves that the queries cannot do without; for all rows of a node at once if it
        leaves over a share ``whole`` of queries and subtrees."""
        if len(tree) == 2:
            if len(rows):
                leaf(*tree, rows)
            return
        points, point_norms, kids, low, high, norm_low, norm_high = tree
        d = distances(self.q[rows], self.norms[rows], points, point_norms)
        slack = 1e-6 * (1 + d.max(axis=1)) if len(rows) else d[:, 0]
        nearest = np.maximum(d[:, :, None] - high, low - d[:, :, None]).max(axis=1) - slack[:, None]  # by query and subtree
        farthest = (d[:, :, None] + high).min(axis=1) + slack[:, None]
        nearest = np.maximum(nearest, 0)
        most = self.high[rows]

        def kept(j: int, least: np.ndarray) -> np.ndarray:
            inner = np.sqrt(np.maximum(self.norms[rows, None] + norm_low[j] - 2 * most, 0))
            outer = self.norms[rows, None] + norm_high[j] - 2 * least
            outer = np.where(outer >= 0, np.sqrt(np.maximum(outer, 0)), -np.inf) + slack[:, None]
            meets = (least <= most) & (nearest[:, j, None] <= outer) & (farthest[:, j, None] >= inner)
            return meets.any(axis=1)

        if whole < 1 and len(rows):
            least = self.least(rows)
            keep = np.stack([kept(j, least) for j in range(len(kids))], axis=1)
            if keep.mean() > whole:
                rows = rows[keep.any(axis=1)]
                leaf(*span(tree), rows)
                return
        for j in np.argsort(d.mean(axis=0), kind="stable").tolist():
            if norm_low[j] > norm_high[j]:  # no rows
                continue
            keep = kept(j, self.least(rows))
            if keep.any():
                self.walk(kids[j], rows[keep], leaf, whole)

    def take(self, rows: np.ndarray, scores: np.ndarray, allowed, ids: np.ndarray) -> None:
        """Rows of a leaf with their scores by query; allowed tells the pairs that count, as a matrix or by their places."""
        low, high = self.low[rows], self.high[rows]
        # scores are whole numbers: where all ids here come after the last one found, its score is no longer enough
        floor = np.maximum(low, self.scores[rows, :, -1] + (ids.min() > self.ids[rows, :, -1])).min(axis=1)
        roof = high.max(axis=1)
        if scores.dtype == np.float32:
            floor, roof = (np.clip(x, -EXACT, EXACT).astype(np.float32) for x in (np.ceil(floor), np.floor(roof)))
        inside = scores >= floor[:, None]
        inside &= scores <= roof[:, None]
        at, column = np.divmod(np.flatnonzero(inside), max(1, scores.shape[1]))
        fits = np.flatnonzero(allowed[at, column] if isinstance(allowed, np.ndarray) else allowed(at, column))
        at, column = at[fits], column[fits]
        values, named = scores[at, column].astype(np.float64), ids[column]
        for w in range(self.low.shape[1]):
            last = self.scores[rows, w, -1][at]
            fits = (values > last) | (values == last) & (named < self.ids[rows, w, -1][at])
            fits = np.flatnonzero(fits & (values >= low[at, w]) & (values <= high[at, w]))
            if not len(fits):
                continue
            one, names, found = at[fits], named[fits], values[fits]
            order = np.lexsort((names, -found, one))
            one, names, found = one[order], names[order], found[order]
            starts = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
            sizes = np.diff(starts, append=len(one))
            rank = np.arange(len(one)) - np.repeat(starts, sizes)
            top, line, some = rank < self.k, np.repeat(np.arange(len(starts)), sizes), rows[one[starts]]
            best, whose = np.full((len(some), 2 * self.k), -np.inf), np.zeros((len(some), 2 * self.k), np.int64)
            best[:, : self.k], whose[:, : self.k] = self.scores[some, w], self.ids[some, w]
            best[line[top], self.k + rank[top]], whose[line[top], self.k + rank[top]] = found[top], names[top]
            order = np.lexsort((whose, -best), axis=1)[:, : self.k]
            self.scores[some, w], self.ids[some, w] = np.take_along_axis(best, order, 1), np.take_along_axis(whose, order, 1)


# ---- index
BLOCKS = "region int, block long, n long, ids binary, rows binary, labels binary, vectors binary, tree binary, near array<double>, far array<double>, norm_low double, norm_high double"


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


ROUTED = "id long, row long, label long, vector binary, region int, part long"


def _routed(tree, dim: int, parts: np.ndarray):
    """Rows with their region, and the part of it (parts has their number by region) to which a task packs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(3), dim)
            region, _ = route(tree, x)
            rows = b.column(1).to_numpy(zero_copy_only=False)
            cells = [*b.columns[:3], pa.array([v.tobytes() for v in x], pa.binary()), pa.array(region.astype(np.int32)), pa.array(rows % parts[region])]
            yield pa.RecordBatch.from_arrays(cells, names=[f.split()[0] for f in ROUTED.split(", ")])

    return run


def _blocks(tree, dim: int):
    levels = max(1, depth_of(tree))

    def pack(region: int, number: int, parts: list) -> pa.RecordBatch:
        ids, rows, labels, x, d = (np.concatenate(p) for p in zip(*parts))
        order: list[np.ndarray] = []
        own = grow(x, np.arange(len(x)), INNER, LEAF, order)
        order = np.concatenate([o[np.argsort(ids[o], kind="stable")] for o in order])
        norms = np.einsum("ij,ij->i", x, x)
        if norms.max() >= OPEN:
            raise ValueError("vectors are too long for exact scores")
        d = d.reshape(len(d), -1)
        cells = [region, number, len(x), *(a[order].tobytes() for a in (ids, rows, labels)), packed(x[order]), pickle.dumps(own), d.min(axis=0).tolist(), d.max(axis=0).tolist(), norms.min(), norms.max()]
        types = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5, *[pa.list_(pa.float64())] * 2, *[pa.float64()] * 2]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=[f.split()[0] for f in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count: dict[int, int] = {}
        number = None
        for b in batches:
            ids, rows, labels = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(ids):
                continue
            if number is None:
                number = int(rows[0])  # a block's number is that of a row of its task
            x = np.frombuffer(b"".join(b.column(3).to_pylist())).reshape(len(ids), dim)
            region, d = route(tree, x)
            order = np.argsort(region, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(region[order])) + 1):
                r = int(region[part[0]])
                for i in range(0, len(part), BLOCK):
                    piece = part[i : i + BLOCK]
                    held.setdefault(r, []).append((ids[piece], rows[piece], labels[piece], x[piece], d[piece]))
                    count[r] = count.get(r, 0) + len(piece)
                    if count[r] >= BLOCK:
                        yield pack(r, number, held.pop(r))
                        number, _ = number + 1, count.pop(r)
            while sum(count.values()) > HELD:
                r = max(count, key=count.get)
                yield pack(r, number, held.pop(r))
                number, _ = number + 1, count.pop(r)
        for r, parts in held.items():
            yield pack(r, number, parts)
            number += 1

    return run, levels


def _anchors(every: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                ids, rows, labels = (np.frombuffer(b.column(c)[k].as_py(), np.int64) for c in (1, 2, 3))
                at = np.flatnonzero(ids % every == 0)
                x = unpacked(b.column(4)[k].as_py(), len(ids), dim)[at].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(ids[at]), pa.array(labels[at]), pa.array(np.full(len(at), b.column(0)[k].as_py(), np.int32)), pa.array([v.tobytes() for v in x], pa.binary())], names=["row", "id", "label", "home", "vector"])

    return run


CHUNKS = "region int, salts int, chunk string, windows int, a_rows binary, a_labels binary, a_vectors binary, a_low binary, a_high binary"


def _chunks(tree, salts: dict[int, int], home: bool):
    """Chunks of anchors (row, label, home, vector, low, high) for the regions they search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, labels, own = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(rows):
                continue
            x = np.frombuffer(b"".join(b.column(3).to_pylist())).reshape(len(rows), -1)
            low, high = (_matrix(b.column(k), int(b.column(4).value_lengths().to_numpy(zero_copy_only=False).max())) for k in (4, 5))
            width = b.column(4).value_lengths().to_numpy(zero_copy_only=False)
            high[np.arange(low.shape[1]) >= width[:, None]] = -OPEN  # windows that an anchor doesn't have hold nothing
            low[np.arange(low.shape[1]) >= width[:, None]] = OPEN
            visits: dict[int, np.ndarray] = {}
            if home:
                for r in np.unique(own).tolist():
                    visits[r] = np.flatnonzero(own == r)
            else:
                Search(x, low, high, 1).walk(tree, np.arange(len(rows)), lambda r, _, at: visits.update({r: at[own[at] != r]}))
            for r, at in visits.items():
                for i in range(0, len(at) if r in salts else 0, CHUNK):
                    part = at[i : i + CHUNK]
                    cells = [r, salts[r], f"{r}/{rows[part[0]]}", low.shape[1], rows[part].tobytes(), labels[part].tobytes(), packed(x[part]), low[part].tobytes(), high[part].tobytes()]
                    types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=[f.split()[0] for f in CHUNKS.split(", ")])

    return run


FOUND = "row long, w int, id long, score long"


def _searched(k: int, same: bool, dim: int):
    """The best k rows of each anchor and window in the blocks that come with its chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = search = rows = labels = asked = None

        def found() -> pa.RecordBatch:
            a, w, j = np.nonzero(search.scores > -np.inf)
            cells = [rows[a], w.astype(np.int32), search.ids[a, w, j], search.scores[a, w, j].astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["row", "w", "id", "score"])

        for b in batches:
            cells = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            for at in range(len(b)):
                get = lambda name, kind=np.float64: np.frombuffer(cells[name][at].as_py(), kind)  # noqa: B023, E731
                if cells["chunk"][at].as_py() != chunk:
                    if search is not None:
                        yield found()
                    chunk, windows = cells["chunk"][at].as_py(), cells["windows"][at].as_py()
                    rows, labels = get("a_rows", np.int64), get("a_labels", np.int64)
                    asked = unpacked(cells["a_vectors"][at].as_py(), len(rows), dim)
                    search = Search(asked.astype(np.float64), get("a_low").reshape(-1, windows), get("a_high").reshape(-1, windows), k)
                ids, others, kinds = get("ids", np.int64), get("rows", np.int64), get("labels", np.int64)
                x = unpacked(cells["vectors"][at].as_py(), len(ids), dim)

                def leaf(start: int, stop: int, q: np.ndarray) -> None:
                    for i in range(start, stop, STRIP):
                        part = slice(i, min(stop, i + STRIP))

                        def allowed(a: np.ndarray, j: np.ndarray) -> np.ndarray:
                            a, j = q[a], j + i  # noqa: B023
                            fits = (labels[a] == kinds[j]) == same  # noqa: B023
                            return fits & (rows[a] != others[j]) if same else fits  # noqa: B023

                        search.take(q, asked[q] @ x[part].T, allowed, ids[part])  # noqa: B023

                search.walk(pickle.loads(cells["tree"][at].as_py()), np.arange(len(rows)), leaf, WHOLE)
        if search is not None:
            yield found()

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of each anchor and window, with their rank from 1."""
    order = Window.partitionBy("row", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, *, every: int = 50, n_positives: int = 5, n_negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. Components become floor(scale * x); a score is the integer
    inner product with the anchor, higher ones first, ties by the smaller id. Positives are an anchor's first rows of its
    label; for each, the first rows of other labels come whose score lies between window percent of the positive's.

    Rows without an id, label or vector, and those with a null or non-finite component, take no part. Missing components
    of vectors shorter than others count as zero. Repeated rows and rows that share an id are rows of their own: each is
    an anchor, and a positive of the others. Where nothing fits there are no rows; an empty table gives none. Vectors
    whose square norm reaches 2^53 after scaling are an error. Other columns are not read.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    sound = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = sound.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    spark = vectors.sparkSession
    dim, total = rows.agg(F.max(F.size("v")), F.count("*")).first()
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "row").select("v").limit(SAMPLE).collect()]
    x = np.zeros((len(sample), dim or 0))
    for k, values in enumerate(sample):
        x[k, : len(values)] = values
    # as deep as blocks get full, and no deeper than the sample can tell
    upper = grow(x, np.arange(len(x)), FANOUT, max(4 * FANOUT, int(len(x) * BLOCK / max(total, 1))), []) if len(x) else (0, 0)
    tree, n_regions = regions(upper)
    shares = np.bincount(route(tree, x)[0], minlength=n_regions) / max(len(x), 1)
    parts = np.ceil(shares * total / (DEALT * BLOCK)).astype(np.int64).clip(1)

    with scratch() as keep:
        dim = dim or 0
        pack, levels = _blocks(tree, dim)
        routed = rows.select("id", "row", "label", "v").mapInArrow(_routed(tree, dim, parts), ROUTED)
        routed = routed.repartition("region", "part").sortWithinPartitions("region", "part")
        index = stage(routed.select("id", "row", "label", "vector").mapInArrow(pack, BLOCKS), "index")
        ranges, salts = {}, {}
        places = index.select("region", F.posexplode(F.arrays_zip("near", "far"))).groupBy("region", "pos").agg(F.min("col.near").alias("near"), F.max("col.far").alias("far")).collect()
        for r in index.groupBy("region").agg(F.count("*").alias("n"), F.min("norm_low").alias("least"), F.max("norm_high").alias("most")).collect():
            ranges[r["region"]] = np.full((levels, FANOUT), np.nan), np.full((levels, FANOUT), np.nan), r["least"], r["most"]
            salts[r["region"]] = -(-r["n"] // SPREAD)
        for r in places:
            for side, name in enumerate(("near", "far")):
                ranges[r["region"]][side].flat[r["pos"]] = r[name]
        tree = with_ranges(tree, ranges)
        keys = spark.createDataFrame(list(salts.items()), "region int, of int")
        blocks = index.join(F.broadcast(keys), "region").select("region", F.pmod("block", "of").cast("int").alias("salt"), "ids", "rows", "labels", "vectors", "tree")
        anchors = stage(index.select("region", "ids", "rows", "labels", "vectors").mapInArrow(_anchors(every, dim), "row long, id long, label long, home int, vector binary"), "anchors")

        full = -(-anchors.count() // CHUNK)
        groups = max(1, -(-full // SPREAD))
        blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        meet = ["region", "salt", "group"]

        def searched(asked: DataFrame, k: int, same: bool) -> DataFrame:
            """(row, w, id, score, rank) of the best k for anchors with windows low, high."""
            found = None
            for home in (True, False):
                if found is not None:  # what the own region gave bounds the search of the others
                    kth = found.groupBy("row", "w").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == k)
                    kth = kth.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("kth"))
                    bound = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("kth", w.cast("int")), x)))
                    asked = asked.join(kth, "row", "left").withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(bound)).drop("kth")
                dealt = asked.select("row", "label", "home", "vector", "low", "high").repartition(max(1, full), "home" if home else "row")
                chunks = dealt.mapInArrow(_chunks(tree, salts, home), CHUNKS)
                chunks = chunks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
                chunks = chunks.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))
                # neither side may be broadcast: Spark takes their sizes from the small files that chunks and blocks come from
                got = chunks.hint("merge").join(blocks, meet).drop(*meet, "salts").mapInArrow(_searched(k, same, dim), FOUND)
                got = stage(_best(got, k).drop("rank"), "found")
                found = got if found is None else found.union(got)
            return _best(found, k)

        wide = anchors.withColumns({"low": F.array(F.lit(-OPEN)), "high": F.array(F.lit(OPEN))})
        positives = stage(searched(wide, n_positives, True).select("row", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        down = lambda x: f"({x} - pmod({x}, 100L)) div 100"
        low, high = f"-({down(f'(-positive_score * {window[0]}L)')})", down(f"(positive_score * {window[1]}L)")
        edges = positives.select("row", "nth", F.expr(low).alias("low"), F.expr(high).alias("high"))
        edges = edges.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "low", "high"))).alias("e")).select("row", F.col("e.low").alias("low"), F.col("e.high").alias("high"))
        negatives = searched(stage(anchors.hint("merge").join(edges, "row"), "windows"), n_negatives, False)
        out = negatives.withColumn("nth", F.col("w") + 1).join(positives, ["row", "nth"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
        out = stage(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        keep(out)
    return out


def relabelled(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding with a seventh of the labels moved on by one, as a noise of labels."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.alias("label"), "embedding")
