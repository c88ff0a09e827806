"""Profiles: one aggregation over all columns, one row for each column in the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, find_columns, numeric_columns, require, string_columns
from .frequent import commonest
from .gram import correlation_pairs
from .selection import quantile_table

#: Columns of one aggregation; wider tables are profiled in several, as generated code is limited in size.
CHUNK = 60


def _tidy(df: DataFrame, columns: list[str], fields: dict[str, tuple]) -> DataFrame:
    """One row (column, fields...) for each column, from one aggregation for each CHUNK of columns.

    fields: name -> (aggregate of a column name, type of the result).
    """
    out = None
    for i in range(0, len(columns), CHUNK):
        part = columns[i : i + CHUNK]
        one = df.agg(*[F.struct(F.lit(c).alias("column"), *[f(c).cast(kind).alias(n) for n, (f, kind) in fields.items()]).alias(f"c{k}") for k, c in enumerate(part)])
        one = one.select(F.explode(F.array(*[f"c{k}" for k in range(len(part))])).alias("x")).select("x.*")
        out = one if out is None else out.union(one)
    return out


def _if_numeric(df: DataFrame, f) -> object:
    numeric = set(numeric_columns(df))
    return lambda c: f(c) if c in numeric else F.max(F.lit(None).cast("double"))


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """column, dtype, n_rows, nulls; min, max, mean (4 places) of numbers; distinct values of others."""
    numeric, kinds = set(numeric_columns(df)), dict(df.dtypes)
    distinct = F.approx_count_distinct if approx else F.count_distinct
    none = F.max(F.lit(None).cast("long"))
    return _tidy(df, df.columns, {
        "dtype": (lambda c: F.max(F.lit(kinds[c])), "string"),
        "n_rows": (lambda c: F.count("*"), "long"),
        "nulls": (lambda c: F.count_if(col(c).isNull()), "long"),
        "min": (_if_numeric(df, lambda c: F.round(F.min(col(c).cast("double")), 4)), "double"),
        "max": (_if_numeric(df, lambda c: F.round(F.max(col(c).cast("double")), 4)), "double"),
        "mean": (_if_numeric(df, lambda c: F.round(F.avg(col(c)), 4)), "double"),
        "n_distinct": (lambda c: none if c in numeric else distinct(col(c)), "long"),
    })


def profile_columns(df: DataFrame, columns: list[str], stats: bool = False) -> DataFrame:
    """column, n_distinct, nulls and, if asked, min and max of numbers (2 places); names match without case."""
    found = find_columns(df, columns)
    fields: dict = {"n_distinct": (lambda c: F.count_distinct(col(c)), "long"), "nulls": (lambda c: F.count_if(col(c).isNull()), "long")}
    if stats:
        fields["min"] = (_if_numeric(df, lambda c: F.round(F.min(col(c).cast("double")), 2)), "double")
        fields["max"] = (_if_numeric(df, lambda c: F.round(F.max(col(c).cast("double")), 2)), "double")
    return _tidy(df, found, fields)


def first_values(df: DataFrame, column: str, order_by: str, n: int = 30) -> DataFrame:
    """The first n distinct values in the order of another column, with the place of their first occurrence."""
    (c,) = find_columns(df, [column])
    return df.where(col(c).isNotNull()).groupBy(col(c).alias("value")).agg(F.min(col(order_by)).alias("first_at")).orderBy("first_at", "value").limit(n)


def value_counts(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """column, value (as text), count: the n commonest non-null values of each column; ties go by value.

    All columns are sketched in one pass and the candidates counted exactly in a second (see frequent).
    """
    if not columns:
        raise ValueError("columns are needed")
    return commonest(df, find_columns(df, columns), n)


def check_missing(df: DataFrame) -> DataFrame:
    """column, missing_pct (1 place) of columns whose rounded share of nulls is above 0."""
    share = {"missing_pct": (lambda c: F.round(F.try_divide(F.count_if(col(c).isNull()) * 100.0, F.count("*")), 1), "double")}
    return _tidy(df, df.columns, share).where("missing_pct > 0")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, count, mean, std (sample), min, p25, p50, p75, max, 4 places; all numeric columns by default.

    Columns of text (or other types) can be asked for in a call of their own: column, count, unique, top, freq, where top is
    the commonest value, of equals the least.
    """
    columns = columns or numeric_columns(df)
    require(df, columns)
    numeric = set(numeric_columns(df))
    if not set(columns) & numeric:
        return _describe_text(df, columns)
    if other := [c for c in columns if c not in numeric]:
        raise ValueError(f"describe columns of numbers and of others apart: {', '.join(other)}")
    r = lambda x: F.round(x, 4)
    out = _tidy(df, columns, {
        "count": (lambda c: F.count(col(c)), "long"),
        "mean": (lambda c: r(F.avg(col(c))), "double"),
        "std": (lambda c: r(F.stddev_samp(col(c))), "double"),
        "min": (lambda c: r(F.min(col(c).cast("double"))), "double"),
        "max": (lambda c: r(F.max(col(c).cast("double"))), "double"),
    })
    out = out.join(F.broadcast(quantile_table(df, {c: col(c) for c in columns}, [0.25, 0.5, 0.75])), "column")
    quartiles = [r(F.get("q", i)).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    return out.select("column", "count", "mean", "std", "min", *quartiles, "max")


def _describe_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, unique, top, freq: value counts of all columns in one pass, then one row for each."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(cells.alias("x")).select("x.*").groupBy("column", "value").agg(F.count("*").alias("n"))
    there = F.col("value").isNotNull()
    top = F.min_by("value", F.when(there, F.struct((-F.col("n")).alias("n"), "value")))
    out = counts.groupBy("column").agg(F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("count"), F.count("value").alias("unique"), top.alias("top"), F.max(F.when(there, F.col("n"))).alias("freq"))
    return df.sparkSession.createDataFrame([(c,) for c in columns], "column string").join(out, "column", "left").select("column", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("unique", F.lit(0)).alias("unique"), "top", "freq")


def percentiles(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """column, p1, p5, p10, p25, p50, p75, p90, p95, p99 with linear interpolation, 4 places.

    Exact by counting in buckets (see selection), in a few passes whose cost does not grow with the distinct values.
    approx takes sketches instead, in one pass.
    """
    columns = columns or numeric_columns(df)
    require(df, columns)
    names = (1, 5, 10, 25, 50, 75, 90, 95, 99)
    shares = [n / 100 for n in names]
    if approx:
        out = _tidy(df, columns, {"q": (lambda c: F.percentile_approx(col(c).cast("double"), F.lit(shares), F.lit(10000)), "array<double>")})
    else:
        out = quantile_table(df, {c: col(c) for c in columns}, shares)
    return out.select("column", *[F.round(F.get("q", i), 4).alias(f"p{n}") for i, n in enumerate(names)])


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete correlation; null where a side is constant."""
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, threshold: float = 0.7, columns: list[str] | None = None) -> DataFrame:
    """col_a, col_b, r (4 places) of the pairs with |r| at or above the threshold, strongest first.

    One pass adds up the products of all columns (see gram), however many they are; a pair counts the rows that have both.
    """
    columns = columns or numeric_columns(df)
    if len(columns) < 2:
        raise ValueError("two numeric columns are needed")
    require(df, columns)
    found = correlation_pairs(df.select(F.array(*[col(c).cast("double") for c in columns]).alias("v")), "v")
    names = F.lit(columns)
    out = found.select(F.get(names, F.col("i").cast("int")).alias("col_a"), F.get(names, F.col("j").cast("int")).alias("col_b"), F.round("r", 4).alias("r"))
    return out.where(F.abs("r") >= threshold).orderBy(F.desc(F.abs("r")), "col_a", "col_b")


def head(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first n rows, 20 at most, in the given order."""
    return df.orderBy(*order_by).limit(min(n, 20))


def tail(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The last n rows, 20 at most, in the given order."""
    return df.orderBy(*[F.desc(c) for c in order_by]).limit(min(n, 20)).orderBy(*order_by)


def sample(df: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """n random rows, 20 at most, without replacement."""
    return df.orderBy(F.rand(seed)).limit(min(n, 20))


def filter_summary(df: DataFrame, predicate: Column) -> DataFrame:
    """count and total of the rows that match, and mean, min, max of each numeric column over them (null if none do)."""
    hit = F.coalesce(predicate, F.lit(False))
    out = [F.count_if(hit).alias("count"), F.count("*").alias("total")]
    for c in numeric_columns(df):
        v = F.when(hit, col(c))
        out += [f(v).cast("double").alias(f"{c}_{n}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return df.agg(*out)


def profile_geochem(df: DataFrame, from_col: str, to_col: str, elements: list[str], by: list[str] | None = None) -> DataFrame:
    """element, n_intervals, total_thickness, min_from, max_to, weighted_mean, max_value, max_grade_thickness, nulls.

    Rows without from or to are left out; a thickness of zero or less is an error. An element whose intervals have no
    thickness gets no row. ``by`` adds group keys, such as the hole.
    """
    require(df, [from_col, to_col, *elements])
    t = col(to_col) - col(from_col)
    rows = df.where(t.isNotNull()).withColumn("_t", F.when(t > 0, t).otherwise(F.raise_error(F.lit("intervals need a positive thickness"))))
    one = []
    for e in elements:
        v = col(e).cast("double")
        mean = F.try_divide(F.sum(v * F.col("_t")), F.sum(F.when(v.isNotNull(), F.col("_t"))))
        one.append(F.struct(F.lit(e).alias("element"), F.round(mean, 4).alias("weighted_mean"), F.round(F.max(v), 4).alias("max_value"), F.round(F.max(v * F.col("_t")), 4).alias("max_grade_thickness"), F.count_if(v.isNull()).alias("nulls")))
    span = [F.count("*").alias("n_intervals"), F.round(F.sum("_t"), 2).alias("total_thickness"), F.round(F.min(col(from_col).cast("double")), 2).alias("min_from"), F.round(F.max(col(to_col).cast("double")), 2).alias("max_to")]
    keys = [col(b) for b in by or []]
    out = rows.groupBy(*keys).agg(*span, F.array(*one).alias("x"))
    out = out.select(*keys, *["n_intervals", "total_thickness", "min_from", "max_to"], F.explode("x").alias("x"))
    return out.select(*keys, "x.element", "n_intervals", "total_thickness", "min_from", "max_to", "x.weighted_mean", "x.max_value", "x.max_grade_thickness", "x.nulls").where("weighted_mean IS NOT NULL")


__all__ = ["check_missing", "correlations", "describe", "filter_summary", "first_values", "head", "pearson", "percentiles", "profile", "profile_columns", "profile_geochem", "sample", "string_columns", "tail", "value_counts"]
