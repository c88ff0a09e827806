"""Golden tests on small frames: null rules, ties, degenerate columns, partition counts."""

import math

import pytest
from pyspark.sql import functions as F

from assayframe.functions import predicates as p
from assayframe.functions.columns import classify_column
from assayframe.operators import anomaly, cleaning, crs, derive, filters, hypotheses, ml, profile, raster, relational, rowid, verify


@pytest.fixture(scope="module")
def lith(spark):
    rows = [(0, 1.0, 10, "granite", 0.1), (1, 2.0, 20, "basalt", 0.5), (2, 3.0, 30, "Granite gneiss", 1.5), (3, None, 40, None, 0.0), (4, 5.0, 50, "schist", 2.0)]
    return spark.createDataFrame(rows, "i long, a double, b long, lith string, `Au ppm` double")


def hits(df, test):
    return [r.i for r in df.where(test).orderBy("i").collect()]


def test_predicates(lith):
    assert hits(lith, p.contains("lith", "gran", case=False)) == [0, 2]
    assert hits(lith, p.startswith("lith", "gran")) == [0]
    assert hits(lith, p.notna("a")) == [0, 1, 2, 4] and hits(lith, p.isna("a")) == [3]
    assert hits(lith, p.between("b", 20, 40)) == [1, 2, 3] and hits(lith, p.between("b", 20, 40, "neither")) == [2]
    assert hits(lith, p.isin("b", [10, 50])) == [0, 4]
    assert hits(lith, p.contains("lith", "gran|schist")) == [0, 4]
    assert hits(lith, p.contains("lith", "^gran|ist$")) == [0, 4]
    assert hits(lith, p.contains("lith", "GRAN|BASALT", case=False)) == [0, 1, 2]
    assert hits(lith, p.contains("lith", "^granite$")) == [0]
    assert hits(lith, p.contains("lith", "a.b", regex=False)) == []
    assert hits(lith, p.not_in("lith", ["granite"])) == [1, 2, 3, 4] == hits(lith, p.ne("lith", ["granite"]))
    assert hits(lith, p.not_(p.gt("a", 1))) == [0, 3]
    assert hits(lith, p.gt("`Au ppm`", 1)) == [2, 4]
    assert hits(lith, p.eq(p.mod("b", 30), 20)) == [1, 4]
    with pytest.raises(ValueError):
        p.contains("lith", "a.*b")


def test_python_remainder(spark):
    row = spark.createDataFrame([(-7, 3)], "a long, b long").select(p.mod("a", F.col("b")).alias("m"), p.floordiv("a", F.col("b")).alias("d"), p.floordiv("a", 0).alias("z")).first()
    assert (row.m, row.d, row.z) == (2, -3, None)


def test_filters(lith):
    assert [r.i for r in filters.filter_rows(lith, "b", "in", "10, 50,,").collect()] == [0, 4]
    assert filters.filter_rows(lith, "b", "==", "x").count() == 0
    assert filters.filter_rows(lith, "lith", "!=", "granite").count() == 4
    assert filters.filter_rows(lith, "a", "contains", r"^3$").count() == 1
    with pytest.raises(ValueError):
        filters.filter_rows(lith, "b", "<", "x")
    assert [r.i for r in filters.rank_by_metric(lith, "a", 9).collect()][-1] == 3


def test_scaling_degenerate(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (3.0, None, 5.0), (None, None, 5.0)], "x double, e double, c double")
    z = derive.standardize(df, ["x", "c"]).collect()
    assert [round(r.x_z, 6) for r in z] == [round(-1 / math.sqrt(2 / 3), 6), round(1 / math.sqrt(2 / 3), 6), 0.0] and all(r.c_z == 0 for r in z)
    n = derive.normalize(df, ["x", "c", "e"]).collect()
    assert [r.x_norm for r in n] == [0.0, 1.0, 0.5] and all(r.c_norm == 0 and r.e_norm is None for r in n)
    assert all(r.c_anom_mad is None and r.c_anom_z is None for r in anomaly.anomaly(anomaly.anomaly(df, ["c"], "mad"), ["c"], "zscore").collect())
    assert derive.compute_ratios(spark.createDataFrame([(1.0, 0.0)], "a double, b double"), ["a/b"]).first()["a_over_b"] is None
    with pytest.raises(Exception, match="negative"):
        derive.log_transform(spark.createDataFrame([(-1.0,)], "a double"), ["a"]).collect()
    assert [r.r for r in profile.correlations(df, 0.0, ["x", "c"]).collect()] == []


def test_empty_tables(spark):
    df = spark.createDataFrame([], "x double, s string")
    assert profile.profile(df).count() == 2 and profile.check_missing(df).count() == 0
    assert derive.standardize(df, ["x"]).count() == 0 and relational.remove_duplicates(df, ["x"]).count() == 0
    assert profile.filter_summary(df, p.gt("x", 1)).first()["count"] == 0


def test_convert(spark):
    df = spark.createDataFrame([("1d",), (" 1.5 ",), ("NA",), (None,)], "v string")
    assert [r.v for r in derive.convert_dtype(df, "v", "float").collect()] == [None, 1.5, None, None]
    with pytest.raises(Exception, match="converted"):
        derive.convert_dtype(df, "v", "float", "raise").collect()
    with pytest.raises(Exception, match="integers"):
        derive.convert_dtype(spark.createDataFrame([(1.5,)], "v double"), "v", "int").collect()


def test_merge_null_keys(spark):
    a, b = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string"), spark.createDataFrame([(None, "m"), (2, "b")], "k long, v string")
    out = {(r.k, r.v_x, r.v_y) for r in relational.merge(a, b, ["k"], "outer").collect()}
    assert out == {(1, "a", None), (None, "n", "m"), (2, None, "b")}
    with pytest.raises(ValueError):
        relational.merge(a, b, ["k"], "cross")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_row_ids_and_smooth_do_not_depend_on_partitions(spark, parts):
    df = spark.range(500).selectExpr("id", "(id * 37) % 500 AS t", "CAST(id % 11 AS DOUBLE) AS v").repartition(parts)
    ids = {r.t: r.row_id for r in rowid.with_row_id(df, ["t"]).collect()}
    assert ids == {t: t for t in range(500)}
    v = {r.t: r.v for r in df.collect()}
    got = {r.t: r.v_smooth for r in relational.smooth(df, "v", 4, "mean", order_by=["t"], bucket=64).collect()}
    assert all(got[t] == (None if t < 2 or t > 498 else sum(v[t + k] for k in (-2, -1, 0, 1)) / 4) for t in range(500))


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, 1, "b")], "i long, k long, s string")
    take = lambda keep: sorted(r.i for r in relational.remove_duplicates(df, ["i"], ["k", "s"], keep).collect())
    assert (take("first"), take("last"), take("none")) == ([1, 3], [2, 3], [3])


def test_pivot_melt(spark):
    df = spark.createDataFrame([(1, "x", None, 1), (1, "x", 5.0, 2), (1, "y", 7.0, 3), (None, "x", 1.0, 4), (2, None, 1.0, 5)], "g long, k string, v double, o long")
    row = relational.pivot(df, ["g"], "k", ["v"], ["y", "x"], "first", "o").collect()
    assert [(r.g, r.v_x, r.v_y) for r in row] == [(1, 5.0, 7.0)]
    assert relational.melt(df, ["o"], ["g", "v"]).count() == 10


def test_pivot_finds_keys(spark):
    df = spark.createDataFrame([(1, "x", 5.0, 1), (1, "x", 7.0, 2), (1, "n", None, 3), (2, "n", None, 4), (3, "y", 1.0, 5)], "g long, k string, v double, o long")
    got = relational.pivot(df, ["g"], "k", ["v"], None, "last", "o")
    assert got.columns == ["g", "v_x", "v_y"] and sorted(tuple(r) for r in got.collect()) == [(1, 7.0, None), (3, None, 1.0)]
    assert sorted(tuple(r) for r in relational.pivot(df, ["g"], "k", ["v"], None, "sum").collect()) == [(1, 0.0, 12.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 1.0)]
    assert [r.v_x for r in relational.pivot(df, ["g"], "k", ["v"], None, "var").collect()] == [2.0]
    assert relational.pivot(df.limit(0), ["g"], "k", ["v"], None, "std").count() == 0
    with pytest.raises(ValueError):
        relational.pivot(df, ["g"], "k", ["v"], None, "mode")


def test_contains_in_large_numbers(spark):
    df = spark.createDataFrame([(1e30,), (2.5,), (None,)], "v double")
    assert [r.v for r in filters.filter_rows(df, "v", "contains", "^2.5$").collect()] == [2.5]
    assert filters.filter_rows(df, "v", "contains", "E30").count() == 1


def test_cleaning(spark):
    cells = ["<0.01", "≤ 0.5", ">10", "ND", "bdl", "-", "1,23", "1,234", "abc", "1.2.3", "<1.2.3", "", None, " 2.5 "]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i long, Au_ppm string")
    got = [r.Au_ppm for r in cleaning.parse_detection_limits(df, ["Au_ppm"]).orderBy("i").collect()]
    assert got == [0.005, 0.25, 10.0, None, None, None, None, None, None, None, None, None, None, 2.5]
    assert [r.Au_ppm for r in cleaning.fix_decimals(df, ["Au_ppm"]).orderBy("i").collect()][6:8] == ["1.23", "1,234"]
    report = cleaning.limit_report(df, ["Au_ppm"]).first()
    assert (report.below, report.above, report.special, report.parse_error) == (3, 1, 3, 6)
    assert cleaning.comma_columns(df) == ["Au_ppm"]
    kinds = {n: classify_column(n) for n in ("Total", "y", "SampleID", "to_depth", "Cu_ppm", "lithology", "notes")}
    assert kinds == {"Total": "geochem", "y": "lat", "SampleID": "hole_id", "to_depth": "metadata", "Cu_ppm": "geochem", "lithology": "metadata", "notes": "unknown"}


def test_geochem_needs_thickness(spark):
    with pytest.raises(Exception, match="thickness"):
        profile.profile_geochem(spark.createDataFrame([(1.0, 1.0, 2.0)], "f double, t double, v double"), "f", "t", ["v"]).collect()


def test_kmeans_and_pca(spark):
    rows = [(i, float(i % 2) * 10 + i * 0.01, float(i % 2) * -8 + i * 0.01) for i in range(60)] + [(99, None, 1.0)]
    df = spark.createDataFrame(rows, "i long, x double, y double")
    label = {r.i: r.cluster_kmeans for r in ml.kmeans(df, ["x", "y"], 2).collect()}
    assert label[99] is None and len({label[i] for i in range(0, 60, 2)}) == 1 and label[0] != label[1]
    out, share = ml.pca(df, ["x", "y"], 2)
    assert abs(sum(share) - 1) < 1e-9 and share[0] > 0.9
    done = out.where("PCA1 IS NOT NULL").agg(F.avg("PCA1").alias("m"), F.corr("PCA1", "PCA2").alias("r")).first()
    assert abs(done.m) < 1e-9 and abs(done.r) < 1e-6


def test_dbscan_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(3, 0.3, (60, 2)), rng.uniform(-3, 6, (20, 2))])
    z = (pts - pts.mean(0)) / pts.std(0)
    near = ((z[:, None] - z[None]) ** 2).sum(-1) <= 0.2**2
    core = near.sum(1) >= 5
    label, k = np.full(len(z), -1), 0
    for i in range(len(z)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = k
            while todo:
                j = todo.pop()
                for m in np.flatnonzero(near[j] & core & (label < 0)):
                    label[m] = k
                    todo.append(m)
            k += 1
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "i long, x double, y double")
    got = {r.i: r.cluster_dbscan for r in ml.dbscan(df, ["x", "y"], "i", 0.2, 5).collect()}
    assert [got[i] for i in range(len(z))] == label.tolist()


def test_projections(spark):
    df = spark.createDataFrame([(117.0, -31.95), (115.86, -31.95)], "x double, y double")
    there = crs.reproject_points(df, "x", "y", 4326, 32750)
    first, e2, h = there.first(), (2 - 1 / 298.257223563) / 298.257223563, math.radians(31.95) / 20000
    arc = sum((1 - e2 * math.sin((i + 0.5) * h) ** 2) ** -1.5 for i in range(20000)) * h * 6378137 * (1 - e2)  # on the zone's meridian
    assert abs(first.x - 500000) < 1e-6 and abs(first.y - (1e7 - 0.9996 * arc)) < 1e-3
    back = crs.reproject_points(there, "x", "y", "EPSG:32750", "EPSG:4326").collect()
    assert all(abs(a.x - b.x) < 2e-8 and abs(a.y - b.y) < 2e-8 for a, b in zip(back, df.collect()))
    with pytest.raises(ValueError):
        crs.reproject_points(df, "x", "y", 4326, 28350)


def grid(spark, f, w=8, h=6):
    cells = spark.createDataFrame([("r", i, j, 5.0 + 10 * j, -5.0 - 10 * i, float(f(i, j))) for i in range(h) for j in range(w)], "raster_id string, row int, col int, x double, y double, b1 double")
    meta = spark.createDataFrame([("r", w, h, 1, "EPSG:32750", 10.0, 0.0, 0.0, 0.0, -10.0, 0.0, None)], "raster_id string, width int, height int, bands int, crs string, a double, b double, c double, d double, e double, f double, nodata double")
    return cells, meta


def test_rasters(spark):
    cells, meta = grid(spark, lambda i, j: 3 * j)
    g = {(r.row, r.col): r.b1 for r in raster.sobel_gradient(cells, meta).collect()}
    assert abs(g[2, 3] - math.sqrt(36 / 2)) < 1e-9 and len(g) == 48
    assert all(r.b1 == 0 for r in raster.sobel_gradient(*grid(spark, lambda i, j: 7)).collect())
    with pytest.raises(Exception, match="flat"):
        raster.texture_entropy(grid(spark, lambda i, j: 7)[0]).collect()
    same, m = raster.align_grids(cells, meta, meta), meta.first()
    assert {(r.row, r.col): r.b1 for r in same.collect()} == {(i, j): 3.0 * j for i in range(m.height) for j in range(m.width)}
    half, new = raster.resample(cells, meta, 0.5)
    assert half.count() == 12 and new.first().a == 20.0 and {r.row for r in half.collect()} == {0, 1, 2}
    clip = raster.clip_to_extent(cells, meta, (10.0, -30.0, 30.0, -10.0))
    assert sorted((r.row, r.col) for r in clip.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    boxed = raster.clip_to_extent(cells, meta, (8.0, -32.0, 32.0, -8.0), outside="null")
    shifted = raster.clip_meta(meta, (8.0, -32.0, 32.0, -8.0)).first()
    assert (shifted.width, shifted.height, shifted.c, shifted.f) == (4, 4, 0.0, 0.0) and boxed.count() == 16 and boxed.where("b1 IS NULL").count() == 12
    assert raster.clip_meta(meta, (900.0, 900.0, 999.0, 999.0)).count() == 0
    two = cells.unionByName(cells.withColumns({"raster_id": F.lit("s"), "b1": F.col("b1") + 1})), meta.unionByName(meta.withColumn("raster_id", F.lit("s")))
    both = {(r.raster_id, r.row, r.col): r.b1 for r in raster.align_grids(*two, meta).collect()}
    assert len(both) == 96 and both["s", 2, 3] == 10.0 and both["r", 2, 3] == 9.0
    assert raster.band_math(cells, "try_divide(b1, 0)").where("b1 IS NULL").count() == 48
    with pytest.raises(ValueError):
        raster.select_bands(cells, [2])


def test_claims(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "i long, v double")
    claims = spark.createDataFrame([(1, 4.5, "v", "mean", None, None), (2, 0.0, "v", "min", None, None), (3, 3.0, "v", "mean", [2, 4], None), (4, 1.0, "v", "max", [5, 99], None), (5, 7.2, "v", "exact", None, 0.05), (6, 9.0, "v", "max", None, None), (7, 8.0, "v", "count", None, None)], "claim_id long, value double, column string, operation string, rows array<long>, tolerance double")
    got = {r.claim_id: (r.status, r.reason, r.actual) for r in verify.verify_claims(df, claims, "i").collect()}
    assert got == {1: ("verified", None, 4.5), 2: ("verified", None, 0.0), 3: ("verified", None, 3.0), 4: ("not_found", "range out of bounds", None), 5: ("verified", None, 7.0), 6: ("verified", None, 9.0), 7: ("failed", None, 10.0)}


def test_claims_on_text(spark):
    df = spark.createDataFrame([(1.0, "granite"), (2.0, None)], "v double, s string")
    claims = spark.createDataFrame([(1, None, "s", "exact", None, None, "granite"), (2, None, "s", "exact", None, None, "basalt"), (3, 1.0, "s", "mean", None, None, None), (4, 1.5, "v", "mean", None, None, None)], "claim_id long, value double, column string, operation string, rows array<long>, tolerance double, text string")
    got = {r.claim_id: (r.status, r.reason) for r in verify.verify_claims(df, claims).collect()}
    assert got == {1: ("verified", None), 2: ("not_found", "no such value"), 3: ("not_found", "not a number column"), 4: ("verified", None)}


def test_hypotheses(spark):
    text = 'Sure: [{"text": "r", "claim_type": "correlation", "column_a": "a", "column_b": "b", "direction": "positive", "magnitude_range": [0.5, 0.7], "reasoning": "they rise together always"}] done'
    df = spark.createDataFrame([(1, text), (2, "1. first\n- none\n2) second\n•. third"), (3, None), (4, "[broken")], "response_id long, response string")
    h = hypotheses.parse_hypotheses(df)
    assert sorted((r.response_id, r.text, r.claim_type) for r in h.collect()) == [(1, "r", "correlation"), (2, "first", "general"), (2, "second", "general"), (2, "third", "general")]
    assert h.where("response_id = 1").select(hypotheses.specificity_score().alias("s")).first().s == 5
    pairs = spark.createDataFrame([("b", "a", 0.6)], "col_a string, col_b string, r double")
    graded = hypotheses.grade_correlation(h, pairs)
    assert [(r.actual_value, r.is_correct) for r in graded.where("response_id = 1").collect()] == [(0.6, True)]
    assert hypotheses.to_samples(graded, "q", "c").count() == 1
    assert [r.is_correct for r in hypotheses.grade_count(h.where("response_id = 1").drop("expected_count").withColumn("expected_count", F.lit(3)), {"total": 3}).collect()] == [True]
