"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.columns import col, numeric_columns, require

OPERATORS = {"==": p.eq, "!=": p.ne, ">": p.gt, "<": p.lt, ">=": p.ge, "<=": p.le}


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def row_condition(df: DataFrame, column: str, op: str, value: str | None = None) -> Column:
    """Condition of filter_rows as a Column.

    == != > < >= <= compare a numeric column with a number (== with other text matches nothing, an order with it is an
    error). in and not_in take values parted by commas. contains searches a regular expression without case in the text
    form. not_null needs no value. != and not_in keep nulls.
    """
    require(df, [column])
    c, numeric = col(column), column in numeric_columns(df)
    if op == "not_null":
        return c.isNotNull()
    if op in OPERATORS:
        if numeric and (number := _number(value)) is not None:
            return OPERATORS[op](c, number)
        if numeric:
            if op not in ("==", "!="):
                raise ValueError(f"{value!r} is no number to order {column} by")
            return F.lit(op == "!=")
        return OPERATORS[op](c, value)
    if op in ("in", "not_in"):
        values = [v.strip() for v in value.split(",") if v.strip()]
        if numeric:
            values = [x for v in values if (x := _number(v)) is not None]
        return p.isin(c, values) if op == "in" else p.not_in(c, values)
    if op == "contains":
        text = F.coalesce(F.regexp_replace(c.try_cast("decimal(38,10)").cast("string"), r"\.?0+$", ""), c.cast("string")) if numeric and df.schema[column].dataType.simpleString() == "double" else c.cast("string")
        return F.coalesce(text.rlike(f"(?i){value}"), F.lit(False))
    raise ValueError(f"unknown operator {op!r}")


def filter_rows(df: DataFrame, column: str, op: str, value: str | None = None) -> DataFrame:
    """Rows for which row_condition holds; plain comparisons reach the scan."""
    return df.where(row_condition(df, column, op, value))


def filter_report(df: DataFrame, column: str, op: str, value: str | None = None) -> DataFrame:
    """before, after and removed rows of filter_rows, in one pass."""
    hit = F.count_if(F.coalesce(row_condition(df, column, op, value), F.lit(False)))
    return df.agg(F.count("*").alias("before"), hit.alias("after")).withColumn("removed", F.expr("before - after"))


def threshold(df: DataFrame, column: str, value: float, direction: str = "above") -> DataFrame:
    """Rows strictly above or below a value; nulls go."""
    require(df, [column])
    if direction not in ("above", "below"):
        raise ValueError(f"direction must be above or below, not {direction!r}")
    return df.where(col(column) > value if direction == "above" else col(column) < value)


def rank_by_metric(df: DataFrame, metric: str, n: int = 10, ties: list[str] | None = None) -> DataFrame:
    """The n rows with the largest metric, nulls last; ties go by the given columns."""
    require(df, [metric, *(ties or [])])
    return df.orderBy(col(metric).desc_nulls_last(), *[col(t) for t in ties or []]).limit(n)
