"""Readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, quoted
from ..operators.graph import keep

# Texts that a table file uses for a missing cell.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
WHOLE, NUMBER = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; it goes when the driver's JVM ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def read_csv(spark: SparkSession, path: str, schema: dict[str, str] | None = None, usecols: list[str] | None = None, nrows: int | None = None) -> DataFrame:
    """Delimited text with a header; null tokens become null. Types are given, or found in one pass over the columns.

    path may be a folder or a pattern. NaN texts are null as well, so no NaN enters a table.
    """
    text = spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"')
    names = usecols or text.columns
    text = text.select(*[F.when(~col(c).isin(NULL_TOKENS), col(c)).alias(c) for c in names])
    if nrows is not None:
        text = text.limit(nrows)
    if schema is None:
        tests = [f(F.coalesce(col(c).rlike(p), F.lit(True))).alias(f"{k}{i}") for i, c in enumerate(names) for k, p, f in (("w", WHOLE, F.bool_and), ("n", NUMBER, F.bool_and))]
        found = text.agg(*tests).first()
        schema = {c: "bigint" if found[f"w{i}"] else "double" if found[f"n{i}"] else "string" for i, c in enumerate(names)}
    return text.select(*[F.trim(col(c)).try_cast(schema[c]).alias(c) if schema.get(c, "string") != "string" else col(c) for c in names])


def read_las(spark: SparkSession, path: str, curves: list[str] | None = None) -> DataFrame:
    """Well logs (~V ~W ~C ~A sections), one row for each depth step: file, step, and one column for each curve.

    Files are read by lines and split like any text, so one long log is read by many tasks. A line's section is that of the
    last section line before it, by the place of its split and its place in that; these few lines of each file, its NULL
    marker and its curve names are joined with its lines. Steps are numbered within splits and shifted by the steps of the
    splits before. The NULL marker of ~W becomes null, as does a value that is no number, and one that a short line lacks.
    A curve that a file lacks is null there. Blank lines and comments are no steps. Listing the curves spares a pass over
    the headers. The columns file and step come before curves; files of one name in several folders are told apart by path.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r", "").alias("line")
    )
    # every scan may cut the files anew, by the cores there are then, so places hold for one scan only
    text = keep(text)
    place = F.struct("start", "id")
    sections = text.where(F.col("line").startswith("~")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.col("start"), F.col("id"), F.substring("line", 2, 1).alias("k")))).alias("sections"))
    before = F.filter("sections", lambda s: F.struct(s["start"], s["id"]) <= place)
    shown = (F.trim("line") != "") & ~F.trim("line").startswith("#") & ~F.col("line").startswith("~")
    lines = text.where(shown).join(sections, "path").withColumn("k", F.element_at(F.transform(before, lambda s: s["k"]), -1)).drop("sections")

    info = lines.where("k <> 'A'")
    mark = F.when(F.col("line").rlike(r"^\s*NULL\s*\."), F.regexp_extract("line", r"^\s*NULL\s*\.\S*\s+(\S+)", 1).try_cast("double"))
    name = F.when(F.col("k") == "C", F.struct("start", "id", F.trim(F.substring_index("line", ".", 1)).alias("name")))
    heads = info.groupBy("path").agg(F.min_by(mark, F.when(mark.isNotNull(), place)).alias("mark"), F.sort_array(F.collect_list(name)).alias("n")).select("path", "mark", F.col("n.name").alias("names"))
    if curves is None:
        curves = [r["n"] for r in heads.select(F.explode("names").alias("n")).distinct().orderBy("n").collect()]

    data = lines.where("k = 'A'").select("path", "start", "id", "line")
    counts = data.groupBy("path", "start").agg(F.count("*").alias("n"))
    order = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("path", "start", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("shift"))
    data = data.withColumn("nth", F.row_number().over(Window.partitionBy("path", "start").orderBy("id")) - 1).join(shifts, ["path", "start"]).join(heads, "path")
    cells = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: F.nullif(x.try_cast("double"), F.coalesce(F.col("mark"), F.lit(float("inf")))))
    rows = data.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("shift") + F.col("nth")).cast("int").alias("step"), "names", cells.alias("cells"))
    return rows.select("file", "step", *[F.get("cells", (F.array_position("names", F.lit(c)) - 1).cast("int")).alias(c) for c in curves])


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> None:
    """The table at path, replaced; Spark's commit protocol keeps unfinished writes unseen."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.options(**({"header": "true"} if format == "csv" else {})).format(format).save(path)


def read_cells(spark: SparkSession, cells: str, meta: str) -> tuple[DataFrame, DataFrame]:
    """A raster's cell and meta tables from Parquet; cells that hold the nodata value become null."""
    m = spark.read.parquet(meta)
    rows = spark.read.parquet(cells).join(F.broadcast(m.select("raster_id", "nodata")), "raster_id", "left")
    bands = [c for c in rows.columns if c.startswith("b") and c[1:].isdigit()]
    clean = {b: F.when(~F.coalesce(F.col(b) == F.col("nodata"), F.lit(False)) & ~F.isnan(b), F.col(b).cast("double")) for b in bands}
    return rows.withColumns(clean).drop("nodata"), m


def write_cells(cells: DataFrame, meta: DataFrame, path: str) -> None:
    """Bands as float, partitioned by raster, in path/cells; meta with the number of bands in path/meta."""
    bands = [c for c in cells.columns if c.startswith("b") and c[1:].isdigit()]
    cells.withColumns({b: F.col(b).cast("float") for b in bands}).write.mode("overwrite").partitionBy("raster_id").parquet(f"{path}/cells")
    meta.withColumn("bands", F.lit(len(bands))).write.mode("overwrite").parquet(f"{path}/meta")


# Names of the coordinate columns, ignoring case.
X_NAMES, Y_NAMES = ["x", "lon", "longitude", "easting"], ["y", "lat", "latitude", "northing"]


def geojson_features(df: DataFrame) -> DataFrame:
    """One column ``value``: a point feature for each row as JSON text, with all columns as properties."""
    x = next((c for c in df.columns if c.lower() in X_NAMES), None)
    y = next((c for c in df.columns if c.lower() in Y_NAMES), None)
    if not x or not y:
        raise ValueError("no coordinate columns (x, lon, longitude, easting; y, lat, latitude, northing)")
    point = F.struct(F.lit("Point").alias("type"), F.array(col(x).cast("double"), col(y).cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*[col(c).alias(c) for c in df.columns]).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def export_geojson(df: DataFrame, path: str) -> None:
    """geojson_features as text, one feature in a line."""
    geojson_features(df).write.mode("overwrite").text(path)


SAMPLE = "prompt string, completion string, specificity_score int, correct boolean, session_id string, hypothesis_index int, claim_type string, actual_value string"


def write_samples(samples: DataFrame, path: str) -> None:
    """Training samples as JSON lines, parted by verdict (correct or rejected); more are added to those there."""
    samples.write.mode("append").partitionBy("verdict").json(path)


def read_samples(spark: SparkSession, *paths: str, correct_only: bool = True) -> DataFrame:
    """The samples of one or more folders, in the schema SAMPLE with the verdict; only the correct ones by default."""
    schema = T.StructType(T._parse_datatype_string(SAMPLE).fields + [T.StructField("verdict", T.StringType())])
    out = spark.read.schema(schema).json(list(paths)) if len(paths) == 1 else None
    if out is None:
        for p in paths:
            one = spark.read.schema(schema).json(p)
            out = one if out is None else out.unionByName(one)
    return out.where("verdict = 'correct'") if correct_only else out


def merge_samples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The correct samples of all folders."""
    return read_samples(spark, *sorted(paths))


def sample_stats(samples: DataFrame) -> DataFrame:
    """verdict, n, n_sessions."""
    return samples.groupBy("verdict").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions"))


__all__ = ["export_geojson", "geojson_features", "merge_samples", "quoted", "read_cells", "read_csv", "read_las", "read_samples", "sample_stats", "shared_path", "write_cells", "write_samples", "write_table"]
