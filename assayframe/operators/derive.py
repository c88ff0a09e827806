"""Projections and derived columns. Statistics come from one aggregated row that is broadcast to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, require

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    require(df, columns)
    return df.select(*[col(c) for c in columns])


def compute_ratios(df: DataFrame, pairs: list[str]) -> DataFrame:
    """For each 'A/B' a column A_over_B; a denominator of 0 gives null."""
    new = {}
    for pair in pairs:
        names = [p.strip() for p in pair.split("/")]
        if len(names) != 2 or not all(names):
            raise ValueError(f"a ratio is written A/B, not {pair!r}")
        require(df, names)
        new[f"{names[0]}_over_{names[1]}"] = F.try_divide(col(names[0]).cast("double"), col(names[1]).cast("double"))
    return df.withColumns(new)


def log_transform(df: DataFrame, columns: list[str], base: str = "e") -> DataFrame:
    """c_log = ln(1 + c), or c_log10 for base "10"; a negative value is an error when the rows are read."""
    require(df, columns)
    checked = lambda c: F.when(col(c) < 0, F.raise_error(F.lit(f"{c} has negative values"))).otherwise(F.log1p(col(c)))
    if base == "10":
        return df.withColumns({f"{c}_log10": checked(c) / F.log(F.lit(10.0)) for c in columns})
    return df.withColumns({f"{c}_log": checked(c) for c in columns})


def with_statistics(df: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """df with aggregates over all its rows as columns, from a one-row table."""
    return df.join(F.broadcast(df.agg(*[v.alias(k) for k, v in stats.items()])))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """c_z: nulls take the mean, then (x - mean) / population deviation; a deviation of 0 divides by 1."""
    require(df, columns)
    stats = {}
    for k, c in enumerate(columns):
        x = col(c).cast("double")
        # the deviation of the filled column: nulls add rows but no squares
        stats |= {f"_m{k}": F.avg(x), f"_s{k}": F.stddev_pop(x) * F.sqrt(F.try_divide(F.count(x), F.count("*")))}
    out = with_statistics(df, stats)
    z = {f"{c}_z": (F.coalesce(col(c).cast("double"), F.col(f"_m{k}")) - F.col(f"_m{k}")) / F.when(F.col(f"_s{k}") == 0, 1.0).otherwise(F.col(f"_s{k}")) for k, c in enumerate(columns)}
    return out.withColumns(z).drop(*stats)


def normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """c_norm: nulls take the mean, then (x - min) / (max - min); a range of 0 gives 0, an all-null column null."""
    require(df, columns)
    stats = {}
    for k, c in enumerate(columns):
        x = col(c).cast("double")
        stats |= {f"_m{k}": F.avg(x), f"_lo{k}": F.min(x), f"_hi{k}": F.max(x)}
    out = with_statistics(df, stats)

    def scaled(k: int, c: str) -> Column:
        lo, hi = F.col(f"_lo{k}"), F.col(f"_hi{k}")
        return F.when(hi == lo, 0.0).otherwise((F.coalesce(col(c).cast("double"), F.col(f"_m{k}")) - lo) / (hi - lo))

    return out.withColumns({f"{c}_norm": scaled(k, c) for k, c in enumerate(columns)}).drop(*stats)


def to_number(x: Column) -> Column:
    """Text as double, null where it isn't a plain number."""
    return F.when(x.cast("string").rlike(NUMBER), F.trim(x.cast("string")).try_cast("double"))


def convert_dtype(df: DataFrame, column: str, to: str, errors: str = "coerce") -> DataFrame:
    """The column as numeric, float, int, str or datetime; what can't be converted is null, or an error for "raise".

    int needs integral values: any other one is an error.
    """
    require(df, [column])
    x = col(column)
    text = isinstance(df.schema[column].dataType.simpleString(), str) and df.schema[column].dataType.simpleString() == "string"
    if to in ("numeric", "float", "int"):
        out = to_number(x) if text else x.cast("double")
        if to == "int":
            out = F.when(out != F.floor(out), F.raise_error(F.lit(f"{column} has values that are not integers"))).otherwise(out).cast("long")
    elif to == "str":
        out = x.cast("string")
    elif to == "datetime":
        out = F.try_to_timestamp(x.cast("string"))
    else:
        raise ValueError(f"unknown type {to!r}")
    if errors == "raise":
        out = F.when(x.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit(f"{column} can't be converted: "), x.cast("string")))).otherwise(out)
    elif errors != "coerce":
        raise ValueError(f"errors must be coerce or raise, not {errors!r}")
    return df.withColumn(column, out)
