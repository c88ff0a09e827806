"""Claims on an index of blocks, outer joins with hot keys, grading by type: against brute force, and how much is joined."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayframe.operators import hypotheses, relational, verify

CLAIM = "claim_id long, value double, column string, operation string, rows array<long>, tolerance double"


def actual(op, values, claimed):
    there = [v for v in values if v is not None]
    if op == "count":
        return float(len(values))
    if not there or op == "std" and len(there) < 2:
        return None
    named = {"mean": statistics.fmean, "sum": sum, "min": min, "max": max, "median": statistics.median, "std": statistics.stdev, "exact": lambda x: min(x, key=lambda v: (abs(v - claimed), v))}
    return float(named[op](there))


@pytest.mark.parametrize("block,few", [(256, 10_000), (8, 3)])
def test_claims_against_brute_force(spark, monkeypatch, block, few):
    monkeypatch.setattr(verify, "BLOCK", block)
    monkeypatch.setattr(verify, "FEW", few)
    rng = random.Random(1)
    n = 700
    columns = {"u": [rng.choice([None, 1e6 + rng.gauss(0, 1), 1e6 + rng.gauss(0, 1)]) for _ in range(n)], "w": [rng.randrange(9) for _ in range(n)]}
    columns["u"][40:60] = [None] * 20
    df = spark.createDataFrame([(i, columns["u"][i], columns["w"][i]) for i in range(n)], "i long, u double, w int").repartition(4)
    claims = []
    for k in range(160):
        c, op = rng.choice("uw"), rng.choice(verify.OPERATIONS)
        lo = rng.choice([0, rng.randrange(n), 40, 8 * rng.randrange(80)])
        rows = None if k % 5 == 0 else [lo, min(n - 1, lo + rng.choice([0, 1, 7, 15, 63, n, rng.randrange(n)]))]
        claimed = rng.choice([1e6, 3.5, 4.0, 0.0])
        claims.append((k, claimed, c, op, rows, None))
    got = {r.claim_id: r for r in verify.verify_claims(df, spark.createDataFrame(claims, CLAIM), "i").collect()}
    for k, claimed, c, op, rows, _ in claims:
        want = actual(op, columns[c] if rows is None else columns[c][rows[0] : rows[1] + 1], claimed)
        r = got[k]
        assert (r.reason == "no values") if want is None else abs(r.actual - want) <= 1e-6 * max(1, abs(want)), (claims[k], r, want)
    with pytest.raises(ValueError, match="row_id"):
        verify.verify_claims(df, spark.createDataFrame([(1, 1.0, "u", "mean", [0, 3], None)], CLAIM))


def test_claims_join_few_rows(spark):
    """2,000 long ranges over 50,000 rows: each is made of a few blocks and border rows, not of its rows."""
    rng = random.Random(2)
    n, m = 50_000, 2000
    df = spark.range(n).selectExpr("id AS i", "CAST(id % 97 AS DOUBLE) AS v")
    ranges = [sorted(rng.sample(range(n), 2)) for _ in range(m)]
    claims = spark.createDataFrame([(k, 48.0, "v", "sum", r, None) for k, r in enumerate(ranges)], CLAIM)
    out = verify.verify_claims(df, claims, "i")
    out.collect()
    joined = []

    def walk(node):
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            joined.append(node.metrics().apply("numOutputRows").value())
        for inner in ([node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []):
            walk(inner)
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(out._jdf.queryExecution().executedPlan())
    assert joined and max(joined) < 2 * verify.BLOCK * m < sum(b - a for a, b in ranges) / 10


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("left,right", [("null", "none"), ("null", "null"), ("x", "y"), ("none", "x"), ("x", "absent")])
def test_outer_join_with_hot_keys(spark, left, right):
    rng = random.Random(3)

    def side(hot, n, share):
        key = {"null": None, "x": 5, "y": 5, "absent": 999}.get(hot)
        return [(key if hot != "none" and rng.random() < share else rng.randrange(200), k, f"r{k % 50}") for k in range(n)]

    a, b = side(left, 3000, 0.9), side(right, 400, 0.02 if left == right or (left, right) == ("x", "y") else 0.5)
    want = Counter()
    of = {}
    for r in b:
        of.setdefault(r[0], []).append(r)
    for r in a:
        for s in of.get(r[0], [(None, None, None)]):
            want[(r[0], r[1], r[2], s[1], s[2])] += 1
    keys = {r[0] for r in a}
    want.update((s[0], None, None, s[1], s[2]) for s in b if s[0] not in keys)
    da = spark.createDataFrame(a, "k long, p long, v string").repartition(3)
    db = spark.createDataFrame(b, "k long, q long, v string").repartition(3)
    assert rows_of(relational.merge(da, db, ["k"], "outer")) == want


def test_no_task_holds_a_hot_key(spark):
    """90 % null keys: after the join no task has more than three times the median task's rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(40_000).selectExpr("IF(id % 10 = 0, id, NULL) AS k", "id AS p")
        b = spark.range(4000).selectExpr("id * 10 AS k", "id AS q")
        out = relational.merge(a, b, ["k"], "outer")
        size = sorted(r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(size) == 40_000 and len(size) == 4 and size[-1] <= 3 * size[len(size) // 2]


def test_pivot_has_a_limit(spark, monkeypatch):
    monkeypatch.setattr(relational, "WIDEST", 3)
    df = spark.range(5).selectExpr("1 AS g", "id AS k", "1.0D AS v")
    with pytest.raises(ValueError, match="more than 3"):
        relational.pivot(df, ["g"], "k", ["v"], None, "sum")
    assert relational.pivot(df, ["g"], "k", ["v"], [0, 1, 2, 3], "sum").first().v_3 == 1.0


def test_evaluate_by_type(spark):
    fields = {f.split()[0]: None for f in hypotheses.HYPOTHESIS.split(", ")}
    made = lambda **x: tuple((fields | {"text": "t"} | x).values())
    h = [
        made(claim_type="correlation", column_a="b", column_b="a", direction="negative"),
        made(claim_type="correlation", column_a="a", column_b="c"),
        made(claim_type="distribution", column_a="a", value_range=[1.0, 3.0]),
        made(claim_type="distribution", column_a="a"),
        made(claim_type="cluster", count_range=[2, 4], cluster_id=9),
        made(claim_type="cluster", cluster_id=1, value_range=[1.0, 3.0]),
        made(claim_type="cluster", cluster_id=1),
        made(claim_type="cluster", cluster_id=7),
        made(claim_type="cluster"),
        made(claim_type="anomaly", column_a="a", expected_count=5),
        made(claim_type="anomaly", count_range=[9, 9]),
        made(claim_type="existence", column_a="a", threshold=2.5),
        made(claim_type="existence", column_a="a", threshold=99.0),
        made(claim_type="existence", column_a="nothing", threshold=0.0),
        made(claim_type="count", expected_count=4),
        made(claim_type="count"),
        *[made(claim_type=k, column_a="a", threshold=0.0, expected_count=4, value_range=[0.0, 9.0]) for k in ("comparison", "trend", "general", "odd", None)],
    ]
    want = [(-0.5, True), (None, None), (2.0, True), (2.0, None), (2.0, True), (2.0, True), (2.0, None), (None, False), (None, None), (6.0, True), (9.0, True), (3.0, True), (0.0, False), (None, None), (4.0, True), (4.0, None), *[(None, None)] * 5]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(h)], "i int, " + hypotheses.HYPOTHESIS)
    source = spark.createDataFrame([(1.0,), (3.0,), (4.0,), (5.0,), (None,)], "a double")
    given = {
        "pairs": spark.createDataFrame([("a", "b", -0.5)], "col_a string, col_b string, r double"),
        "stats": spark.createDataFrame([("a", 2.0)], "column string, mean double"),
        "clusters": spark.createDataFrame([(0, 5), (1, 2)], "cluster int, size long"),
        "anomalies": spark.createDataFrame([("a", 6), ("b", 3)], "column string, n long"),
        "rows": source, "columns": ["a"], "result": {"other": 1, "total": 4},
    }
    got = [(r.actual_value, r.is_correct) for r in hypotheses.evaluate(df, **given).orderBy("i").collect()]
    assert got == want
    assert all((r.actual_value, r.is_correct) == (None, None) for r in hypotheses.evaluate(df).collect())
    for kind, grade in (("cluster", lambda x: hypotheses.grade_cluster(x, given["clusters"])), ("correlation", lambda x: hypotheses.grade_correlation(x, given["pairs"]))):
        one = grade(df.where(F.col("claim_type") == kind)).orderBy("i").collect()
        assert [(r.actual_value, r.is_correct) for r in one] == [w for w, x in zip(want, h) if x[1] == kind]


def test_thresholds_are_counted_once(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS v")
    claims = spark.createDataFrame([("v", t) for t in (-1.0, 0.0, 499.5, 998.0, 999.0, 5000.0)], "column string, t double")
    got = {r.t: r.n for r in hypotheses._above(df, ["v"], claims).collect()}
    assert got == {-1.0: 1000, 0.0: 999, 499.5: 500, 998.0: 1, 999.0: 0, 5000.0: 0}


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_the_pairs_of_a_hot_key_are_spread(spark, monkeypatch, how):
    """Null on both sides, a key that only one side has often, and one of each side's own: all rows, and no task with many."""
    monkeypatch.setattr(relational, "PAIRS", 2000)
    a = spark.range(900).selectExpr("CASE WHEN id < 300 THEN NULL WHEN id < 600 THEN -1 ELSE id END AS k", "id AS p")
    b = spark.range(500).selectExpr("CASE WHEN id < 120 THEN NULL WHEN id < 300 THEN -2 ELSE id + 300 END AS k", "id AS q")
    out = relational.merge(a, b, ["k"], how)
    size = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    left, right = ({r[1]: r[0] for r in df.collect()} for df in (a, b))
    want = [(k, p, q) for p, k in left.items() for q, j in right.items() if j == k]
    want += [(k, p, None) for p, k in left.items() if k not in right.values()] if how in ("left", "outer") else []
    want += [(j, None, q) for q, j in right.items() if j not in left.values()] if how in ("right", "outer") else []
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert sum(size) == len(want) and max(size) < 0.4 * 300 * 120
