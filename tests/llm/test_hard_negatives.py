"""Hard negatives against scoring every anchor with every row."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from assayframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, region string, row string"


def brute(rows, every=50, n_pos=5, n_neg=3, window=(50, 95)):
    sound = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    ints = [[math.floor(256 * float(np.float32(x))) for x in r[2]] for r in sound]
    out = []
    for a, r in enumerate(sound):
        if r[0] % every:
            continue
        scores = [sum(x * y for x, y in zip(ints[a], v)) for v in ints]
        pos = sorted((-scores[k], s[0]) for k, s in enumerate(sound) if k != a and s[1] == r[1])[:n_pos]
        for p, i in pos:
            fits = sorted((-scores[k], s[0]) for k, s in enumerate(sound) if s[1] != r[1] and window[0] * -p <= 100 * scores[k] <= window[1] * -p)
            out += [(r[0], i, n, j, -p, -q) for n, (q, j) in enumerate(fits[:n_neg], 1)]
    return Counter(out)


def found(df):
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def made(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + 0.6 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), int(rng.integers(0, 4)), [float(v) for v in np.float32(x[i])], "r", "s") for i in range(n)]


@pytest.mark.parametrize("sample,block,leaf,chunk,spread", [(8192, 4096, 128, 1024, 64), (200, 40, 8, 5, 2)])
def test_against_brute_force(spark, monkeypatch, sample, block, leaf, chunk, spread):
    for name, value in (("SAMPLE", sample), ("BLOCK", block), ("LEAF", leaf), ("CHUNK", chunk), ("SPREAD", spread), ("HELD", 200)):
        monkeypatch.setattr(hn, name, value)
    rows = made(900, 6, 1)
    copy = rows[3][2]
    rows += [(2000 + k, k % 3, copy, None, None) for k in range(300)]  # copies: ties, and rows that nothing parts
    rows += [(3000, 1, None, "", ""), (3001, None, copy, "", ""), (None, 1, copy, "", ""), (3050, 1, [1.0, None], "", ""), (3100, 1, [1.0, float("nan")], "", ""), (3150, 2, [float("inf")], "", "")]
    rows += [(3200, 0, [], "", ""), (3250, 0, [0.5], "", ""), (3300, 1, [x * 3 for x in copy], "", ""), rows[50], rows[50], (50, 3, rows[7][2], "", "")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(hn.hard_negatives(df)) == brute(rows)
    assert found(hn.hard_negatives(df, every=300, n_positives=2, n_negatives=7, window=(-20, 200))) == brute(rows, 300, 2, 7, (-20, 200))


def test_empty_and_alone(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(50, 1, [1.0], "", ""), (51, 2, [1.0], "", "")], SCHEMA)).count() == 0


def test_chunks_of_anchors_are_never_broadcast(spark, monkeypatch):
    """The file of anchors is small, the chunks made of it are not: each anchor goes to every region it may search."""
    monkeypatch.setattr(hn, "BLOCK", 256)  # many regions
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, k % 3, [float(v) for v in np.float32(x[k])], "r", "s") for k in range(len(x))]
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "80m")  # the least relation takes a page of memory, up to 64 MB
    try:
        got = found(hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), every=2))
    finally:
        spark.conf.unset(limit)
    ints = np.floor(256 * np.float32(x).astype(float))
    anchors = ints[::2]
    assert {k[0] for k in got} == {2 * a for a in range(len(anchors))}
    for (a, p, _, n, s, t), times in got.items():
        assert times == 1 and a != p and a % 3 == p % 3 != n % 3 and (s, t) == (ints[a] @ ints[p], ints[a] @ ints[n]) and 50 * s <= 100 * t <= 95 * s


def test_siblings_are_eliminated():
    """On clustered rows a search looks at a small part of them; on any rows it gives what scoring all gives."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(size=(40, 4))[rng.integers(0, 40, 20_000)] + 0.02 * rng.normal(size=(20_000, 4))))
    order = []
    tree = hn.grow(x, np.arange(len(x)), 8, 64, order)
    order = np.concatenate(order)
    x, seen = x[order], []
    q = x[rng.integers(0, len(x), 50)]
    scores = q @ x.T
    best = np.sort(scores, axis=1)[:, -100]
    search = hn.Search(q, np.full((50, 1), -np.inf), best[:, None] * 0.999, 3)

    def leaf(a, b, rows):
        seen.append(len(rows) * (b - a))
        search.take(rows, q[rows] @ x[a:b].T, np.ones((len(rows), b - a), bool), np.arange(a, b))

    search.walk(tree, np.arange(50), leaf)
    for k in range(50):
        inside = np.where(scores[k] <= best[k] * 0.999, scores[k], -np.inf)
        assert sorted(search.scores[k, 0]) == sorted(inside)[-3:]
    assert sum(seen) < 0.25 * 50 * len(x)


@pytest.mark.parametrize("size,kind", [(50, np.float32), (50_000, np.float64)])
def test_nodes_scored_whole(size, kind):
    """Hardly anything is eliminated among even rows, so nodes are scored whole, in strips; results are those of all scores."""
    rng = np.random.default_rng(4)
    x = np.floor(size * rng.normal(size=(3000, 16)))
    x[100:140] = x[7]  # ties
    order = []
    tree = hn.grow(x, np.arange(len(x)), 8, 64, order)
    order = np.concatenate(order)
    ids, labels = rng.permutation(len(x)), rng.integers(0, 3, len(x))
    q = np.concatenate([x[:40], x[100:103]])
    assert hn.span(tree) == (0, len(x)) and len(tree) > 2
    ready = hn.unpacked(hn.packed(x[order]), len(x), 16)
    assert ready.dtype == kind and (ready == x[order]).all()
    scores = (q @ x.T).astype(np.int64)
    high = np.quantile(scores, [0.5, 0.9, 1], axis=1).T.round()
    low = np.stack([high[:, 0] - 10**5 * size, high[:, 0], high[:, 2]], axis=1)
    search, calls = hn.Search(q, low, high, 4), []

    def leaf(a, b, rows):
        calls.append((a, b))
        for i in range(a, b, 500):
            j = min(b, i + 500)
            search.take(rows, q[rows].astype(kind) @ ready[i:j].T, lambda r, c: labels[rows[r]] != labels[order[i + c]], ids[order[i:j]])

    search.walk(tree, np.arange(len(q)), leaf, 0.5)
    assert calls[0] == (0, len(x))
    for a in range(len(q)):
        for w in range(3):
            fits = [(-scores[a, j], ids[j]) for j in range(len(x)) if labels[j] != labels[a] and low[a, w] <= scores[a, j] <= high[a, w]]
            got = [(-s, i) for s, i in zip(search.scores[a, w], search.ids[a, w]) if s > -np.inf]
            assert got == sorted(fits)[:4]
