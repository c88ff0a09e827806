"""Operators whose work is spread: exact selection, halo buckets, metric regions. Results, and where the work goes."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.operators import frequent, gram, ml, profile, regions, relational, selection

DATA = "/root/testdata/sf0.01"


def quantile(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    a, b = values[math.floor(at)], values[math.ceil(at)]
    return a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b


def test_ordered_bits_follow_the_numbers():
    x = np.array([-math.inf, -1e300, -2.0, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e300, math.inf])
    key = selection.ordered_bits(x)
    assert (key[1:] >= key[:-1]).all() and key[4] == key[5] and len(set(key.tolist())) == len(x) - 1
    assert [selection.from_bits(int(k)) for k in key] == x.tolist()


def test_order_statistics(spark):
    rng = random.Random(1)
    columns = {
        "close": [1.0 + rng.randrange(5000) * 2**-52 for _ in range(3000)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(3000)],
        "few": [float(rng.choice([3, 3, 3, -7])) for _ in range(3000)],
        "same": [4.25] * 3000,
        "holes": [None if k % 3 else rng.gauss(0, 1) for k in range(3000)],
        "none": [None] * 3000,
        "one": [None] * 2999 + [8.0],
        "two": [None] * 2998 + [8.0, -0.0],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(5)
    shares = [0, 0.01, 0.25, 0.5, 0.77, 0.99, 1]
    found = selection.order_statistics(df, {c: F.col(c) for c in columns}, shares)
    for c, values in columns.items():
        there = [v for v in values if v is not None]
        assert found[c] == ([quantile(there, s) for s in shares] if there else [None] * len(shares)), c
    assert selection.order_statistics(df.limit(0), {"few": F.col("few")}, [0.5]) == {"few": [None]}
    assert selection.order_statistics(df, {"n": F.col("few") * 2}, [0.5]) == {"n": [6.0]}


def test_no_percentile_over_whole_tables(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x")
    for out in (profile.percentiles(df), profile.describe(df)):
        assert "percentile" not in out._jdf.queryExecution().toString().lower()
    assert profile.percentiles(df).first().p25 == 249.75


@pytest.mark.parametrize("small", [1 << 20, 10])
def test_grouped_quantiles(spark, monkeypatch, small):
    monkeypatch.setattr(selection, "SMALL", small)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(3), rng.choice([None, rng.gauss(0, 5), 1.0]), rng.random()) for _ in range(700)] + [("z", 1, None, 2.0)]
    df = spark.createDataFrame(rows, "g string, h long, x double, y double").repartition(4)
    got = {(r.g, r.h): (r.x, r.y) for r in selection.grouped_quantiles(df, ["g", "h"], ["x", "y"]).collect()}
    want = {}
    for key in {(r[0], r[1]) for r in rows}:
        own = [[v for r in rows if (r[0], r[1]) == key and (v := r[k]) is not None] for k in (2, 3)]
        want[key] = tuple(quantile(v, 0.5) if v else None for v in own)
    assert got == want


def test_describe_text(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("b", None), (None, None)], "s string, n long").withColumn("none", F.lit(None).cast("string"))
    got = {r.column: tuple(r)[1:] for r in profile.describe(df, ["s", "none"]).collect()}
    assert got == {"s": (4, 2, "a", 2), "none": (0, 0, None, None)}
    with pytest.raises(ValueError, match="apart"):
        profile.describe(df, ["s", "n"])


@pytest.mark.parametrize("method,window", [("mean", 3), ("mean", 4), ("median", 5)])
def test_smoothing_of_a_hot_key(spark, method, window):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, "hot", "hot", "hot", "hot", "cold"]), rng.randrange(10**6) if k % 5 else None, float(rng.randrange(50))) for k in range(1200)]
    df = spark.createDataFrame(rows, "i long, user string, t long, v double").withColumn("v", F.expr("IF(i % 50 = 0, NULL, v)")).repartition(3)
    before, after = window // 2, (window - 1) // 2
    want = {}
    for user in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == user), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        values = [None if r[0] % 50 == 0 else r[3] for r in own]
        for k, r in enumerate(own):
            near = [v for v in values[max(0, k - before) : k + after + 1] if v is not None]
            want[r[0]] = None if len(near) < window else (sum(near) / window if method == "mean" else sorted(near)[window // 2])
    out = relational.smooth(df, "v", window, method, order_by=["t", "i"], partition_by=["user"], bucket=32)
    assert out.columns == ["i", "user", "t", "v", "v_smooth"]
    got = {r.i: r.v_smooth for r in out.collect()}
    assert got.keys() == want.keys() and all(got[i] == want[i] or abs(got[i] - want[i]) < 1e-9 for i in got)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # one key, many tasks
        where = out.withColumn("p", F.spark_partition_id()).where("user = 'hot'").groupBy("p").agg(F.count("v_smooth").alias("n"))
        assert where.where("n > 0").count() >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_dbscan(z, eps, least):
    near = ((z[:, None] - z[None]) ** 2).sum(-1) <= eps**2
    core = near.sum(1) >= least
    label, k = np.full(len(z), -1), 0
    for i in range(len(z)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], k
            while todo:
                for m in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[m] = k
                    todo.append(m)
            k += 1
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    return label


@pytest.mark.parametrize("region,block,spread", [(256, 2048, 64), (20, 16, 1)])
def test_dbscan_by_regions(spark, monkeypatch, region, block, spread):
    for name, value in (("REGION", region), ("BLOCK", block), ("SPREAD", spread), ("HELD", 200)):
        monkeypatch.setattr(regions, name, value)
    rng = np.random.default_rng(7)
    ring = np.stack([np.cos(np.arange(120) / 19), np.sin(np.arange(120) / 19)], axis=1) * 3 + 6
    pts = np.concatenate([rng.normal(0, 0.3, (150, 2)), rng.normal(3, 0.3, (100, 2)), ring, rng.uniform(-3, 10, (80, 2)), np.full((200, 2), 1.5), [[1.0, 1.0], [1.0, 1.25]] * 3])
    pts = pts[rng.permutation(len(pts))]
    z = (pts - pts.mean(0)) / pts.std(0)
    want = brute_dbscan(z, 0.15, 4).tolist()
    assert len(set(want)) > 4 and -1 in want
    rows = [(i, f"k{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(pts)]
    df = spark.createDataFrame([*rows, (len(rows), f"k{len(rows):04d}", None, 1.0)], "i long, s string, x double, y double").repartition(3)
    got = {r.i: r.cluster_dbscan for r in ml.dbscan(df, ["x", "y"], "i", 0.15, 4).collect()}
    assert [got[i] for i in range(len(z))] == want and got[len(z)] is None
    if region == 20:  # ids need not be numbers; the features may be one array
        text = ml.dbscan(df.withColumn("f", F.array("x", "y")), "f", "s", 0.15, 4)
        assert [r.cluster_dbscan for r in text.orderBy("s").collect()][: len(z)] == want
    assert ml.dbscan(df.limit(0), ["x", "y"], "i").count() == 0
    assert [r.cluster_dbscan for r in ml.dbscan(df.where("x IS NULL"), ["x", "y"], "i").collect()] == [None]


def test_regions_hold_all_neighbours():
    rng = np.random.default_rng(8)
    for dim, eps in ((2, 0.1), (3, 0.4), (8, 1.0)):
        x = rng.normal(size=(600, dim))
        found = regions.choose(x, 12_000, eps)
        home, sent = found.members(x)
        i, j = np.nonzero(regions.within(x, x, eps))
        assert sent[i, home[j]].all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_dbscan_compares_few_pairs(spark, monkeypatch):
    """Of the given embeddings' first three values, at an eps that gives several clusters and noise."""
    monkeypatch.setattr(regions, "REGION", 8)
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 3).alias("f"))
    rows = ml.standardized(df, "f").select(F.col("vec_id").alias("id"), F.col("_z").alias("z"))
    found = regions.fitted(rows, 0.3, 500)
    stored = regions.blocks(rows.withColumns({"weight": F.lit(1).cast("long"), "mark": F.lit(True)}), found)
    size = {(r.region, r.home): r.n for r in stored.groupBy("region", "home").agg(F.sum("n").alias("n")).collect()}
    compared = sum(n * (n + size.get((r, False), 0)) for (r, home), n in size.items() if home)
    labels = [r.cluster_dbscan for r in ml.dbscan(df, "f", "vec_id", 0.3, 5).collect()]
    assert len(set(labels)) > 3 and -1 in labels and compared < 0.1 * 500**2


def test_correlations_in_one_pass(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 40)) + 1e7
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=400)
    x[:, 5] = 3.3
    there = rng.random((400, 40)) > 0.1
    there[:, 5] = True
    df = spark.createDataFrame([tuple(float(v) if t else None for v, t in zip(row, own)) for row, own in zip(x, there)], ", ".join(f"c{k} double" for k in range(40))).repartition(4)
    out = profile.correlations(df, 0.0)
    assert out._jdf.queryExecution().toString().count("MapInArrow") >= 1
    got = {(r.col_a, r.col_b): r.r for r in out.collect()}
    assert len(got) == 39 * 38 // 2  # no pair of the constant column
    for (a, b), r in got.items():
        i, j = int(a[1:]), int(b[1:])
        both = there[:, i] & there[:, j]
        assert abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-4


def test_pca_from_the_gram_matrix(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 50
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / 299)
    v = vectors[:, ::-1][:, :2]
    v *= np.sign(v[np.abs(v).argmax(0), range(2)])
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)] + [(300, None)], "i long, f array<double>")
    out, share = ml.pca(df, "f", 2)
    got = {r.i: (r.PCA1, r.PCA2) for r in out.collect()}
    assert got[300] == (None, None) and np.allclose([got[i] for i in range(300)], z @ v) and np.allclose(share, values[::-1][:2] / values.sum())
    assert np.allclose(gram.moments(df.where("f IS NOT NULL"), "f"), [x.mean(0), x.std(0)])
    assert ml.pca(df.limit(0), "f", 2)[0].count() == 0


@pytest.mark.parametrize("counters", [4096, 6])
def test_value_counts(spark, monkeypatch, counters):
    monkeypatch.setattr(frequent, "COUNTERS", counters)
    rng = random.Random(12)
    skewed = [rng.choice("abc") if rng.random() < 0.7 else f"v{rng.randrange(400)}" for _ in range(4000)]
    rows = [(skewed[k], k, [3, 3, 1, 10, 2][k % 5], None, rng.choice([None, "x"])) for k in range(4000)]
    df = spark.createDataFrame(rows, "s string, id long, few int, none string, holes string").repartition(4)
    out = profile.value_counts(df, ["s", "id", "few", "none", "holes"], 3)
    got = {}
    for r in out.collect():
        got.setdefault(r.column, []).append((r.value, r["count"]))
    for k, c in enumerate(df.columns):
        counts = {}
        for r in rows:
            if r[k] is not None:
                counts[r[k]] = counts.get(r[k], 0) + 1
        assert got.get(c, []) == [(str(v), n) for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]], c
    assert profile.value_counts(df.limit(0), ["s"]).count() == 0


def test_sketch_bounds():
    """True counts lie between a counter and the counter plus the error, which is at most the rows / size."""
    rng = random.Random(13)
    for size in (5, 50):
        sketch, true, n = frequent.Counters(size), {}, 0
        for _ in range(60):
            values = [int(rng.paretovariate(0.6)) % 1000 for _ in range(100)]
            for v in values:
                true[v] = true.get(v, 0) + 1
            sketch.add(values, [1] * len(values))
            n += len(values)
        sketch.prune()
        assert len(sketch.counts) <= size and sketch.error <= n / size
        assert all(sketch.counts.get(v, 0) <= k <= sketch.counts.get(v, 0) + sketch.error for v, k in true.items())


def test_kmeans_goes_on_until_no_centre_moves(spark, monkeypatch):
    """Evenly spaced points need many steps, and no number of steps is the limit."""
    from pyspark.ml import clustering

    limits, fit = [], clustering.KMeans.fit
    monkeypatch.setattr(clustering.KMeans, "fit", lambda self, *a: (limits.append(self.getMaxIter()), fit(self, *a))[1], raising=False)
    df = spark.range(2000).selectExpr("id", "CAST(id AS DOUBLE) AS x").repartition(2)

    def still(**more):
        rows = np.array([(r.x, r.cluster_kmeans) for r in ml.kmeans(df, ["x"], 10, **more).select("x", "cluster_kmeans").collect()])
        x, label = rows[:, 0], rows[:, 1].astype(int)
        d = np.abs(x[:, None] - np.bincount(label, x) / np.bincount(label))
        return (d[np.arange(len(x)), label] <= d.min(axis=1) + 1e-6).all()

    assert still() and not still(max_iter=3) and limits == [ml.UNTIL_STILL, 3]


def test_dbscan_leaves_known_cores_out(spark, monkeypatch):
    """One large region: points that are known to be cores, or to be linked, are not compared with all others."""
    for name, value in (("BLOCK", 64), ("HELD", 64), ("MOST", 1)):
        monkeypatch.setattr(regions, name, value)
    compared, real = [], regions.block_pairs

    def counted(own, others):
        rows = lambda df: df.agg(F.sum("n")).first()[0] or 0
        compared.append(rows(own.where("home")) * rows(others))
        return real(own, others)

    monkeypatch.setattr(regions, "block_pairs", counted)
    x = np.random.default_rng(9).normal(size=(1500, 2))
    x[:3] += 40
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, x double, y double").repartition(2)
    z = (x - x.mean(0)) / x.std(0)
    got = {r.i: r.cluster_dbscan for r in ml.dbscan(df, ["x", "y"], "i", 0.5, 5).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(z, 0.5, 5).tolist() and got[0] == -1
    assert sum(compared) < 1500**2  # all pairs twice before
