"""Readers and writers on files in a temporary folder."""

import json

from pyspark.sql import functions as F

from assayframe import queries
from assayframe.sources import tables


def test_csv_null_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,i,s\nNA,1,x\nnan,2,NA\nN/A,,1d\n 1.5 ,4,y\n,5,\n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"n": "double", "i": "bigint", "s": "string"}
    assert sorted((r.n, r.i, r.s) for r in df.where("i IS NOT NULL").collect() if r.n) == [(1.5, 4, "y")]
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), usecols=["i"], nrows=2).count() == 2


def test_las(spark, tmp_path):
    log = "~V\n VERS. 2.0 : v\n~W\n STRT.M 0 : s\n NULL. -999.25 : n\n~C\n DEPT.M : depth\n {c}.API : curve\n~A\n 0.0 {x}\n 0.5 -999.25\n"
    (tmp_path / "one.las").write_text(log.format(c="GR", x="10.5"))
    (tmp_path / "two.las").write_text(log.format(c="RHOB", x="2.5"))
    rows = tables.read_las(spark, str(tmp_path)).orderBy("file", "step").collect()
    assert [(r.file, r.DEPT, r.GR, r.RHOB) for r in rows] == [("one.las", 0.0, 10.5, None), ("one.las", 0.5, None, None), ("two.las", 0.0, None, 2.5), ("two.las", 0.5, None, None)]


def test_geojson(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 2.5, None)], "Easting double, NORTHING double, Au double")
    tables.export_geojson(df, str(tmp_path / "g"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert json.loads(line) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"Easting": 1.5, "NORTHING": 2.5, "Au": None}}


def test_samples(spark, tmp_path):
    df = spark.createDataFrame([("p", "c", 3, True, "s1", 0, "count", "1", "correct"), ("p", "d", 2, False, "s1", 1, "count", "2", "rejected")], tables.SAMPLE + ", verdict string")
    tables.write_samples(df, str(tmp_path / "s"))
    assert [r.completion for r in tables.merge_samples(spark, [str(tmp_path / "s")]).collect()] == ["c"]
    assert {r.verdict: r.n for r in tables.sample_stats(tables.read_samples(spark, str(tmp_path / "s"), correct_only=False)).collect()} == {"correct": 1, "rejected": 1}


def test_cells(spark, tmp_path):
    cells = spark.createDataFrame([("r", 0, 0, 0.5, 0.5, 1.0), ("r", 0, 1, 1.5, 0.5, -9.0)], "raster_id string, row int, col int, x double, y double, b1 double")
    meta = spark.createDataFrame([("r", -9.0)], "raster_id string, nodata double")
    tables.write_cells(cells, meta, str(tmp_path / "w"))
    got, _ = tables.read_cells(spark, str(tmp_path / "w/cells"), str(tmp_path / "w/meta"))
    assert sorted(((r.col, r.b1) for r in got.collect())) == [(0, 1.0), (1, None)]


def test_write_table(spark, tmp_path):
    tables.write_table(spark.range(5).withColumn("p", F.col("id") % 2), str(tmp_path / "t"), partition_by=["p"])
    assert spark.read.parquet(str(tmp_path / "t")).where("p = 1").count() == 2


def test_a_long_log_is_read_by_many_tasks(spark, tmp_path):
    """Sections and steps carry over splits, also where a header spans several."""
    n = 3000
    head = ["~V", " VERS. 2.0 : v", "~W", "# " + "x" * 3000, " NULL. -9 : n", "~C", " DEPT.M : depth", "# " + "y" * 3000, " GR.API : gamma", " Z. : last", "~A DEPT GR Z"]
    body = [x for k in range(n) for x in ([f"{k}.5 {-9 if k % 7 == 0 else k} {k % 3}"] if k % 10 else ["# note", "", f"{k}.5 {k}"])]
    (tmp_path / "long.las").write_text("\r\n".join(head + body))
    (tmp_path / "short.las").write_text("\n".join(["~C", " DEPT. : d", "~A", "1 2 3"]))
    settings = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = tables.read_las(spark, str(tmp_path))
        rows = {r.step: r for r in out.where("file = 'long.las'").collect()}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 15
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert out.columns == ["file", "step", "DEPT", "GR", "Z"] and sorted(rows) == list(range(n))
    assert all((r.DEPT, r.GR, r.Z) == (k + 0.5, float(k) if k % 10 == 0 or k % 7 else None, None if k % 10 == 0 else float(k % 3)) for k, r in rows.items())
    assert [(r.step, r.DEPT, r.GR, r.Z) for r in out.where("file = 'short.las'").collect()] == [(0, 1.0, None, None)]
    assert tables.read_las(spark, str(tmp_path), ["GR", "none"]).columns == ["file", "step", "GR", "none"]


def test_a_balance_like_the_marker_of_gaps(spark, tmp_path):
    rows = [(1, 5, -999.25), (2, 5, -1998.5), (7, 5, 3.0), (101, 6, -999.25), (102, 6, None), (205, 6, None)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = {(r.log, r.depth): (r.nation, r.balance) for r in queries.QUERIES["read_las"](spark, str(tmp_path)).collect()}
    assert got == {(k // 100, float(k % 100)): (float(n), b if k % 7 else None) for k, n, b in rows}
