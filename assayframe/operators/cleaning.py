"""Cleaning and validation of assay tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import classify_column, classify_columns, col, numeric_columns, require, string_columns
from .profile import CHUNK, _tidy
from .relational import duplicate_counts
from .selection import order_statistics

# Words for a missing assay, and the form of a value with a detection limit.
SPECIAL = ["nd", "bdl", "na", "trace", "nil", "-"]
LIMIT = r"^([<>≤≥]|<=|>=)\s*([\d.]+)$"
COMMA = r"^\d+,(\d+)$"
DEPTH_NAMES = ["depth", "from", "from_m", "depth_from"]
PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def is_detection_limit(x: Column) -> Column:
    t = F.trim(x)
    return F.coalesce(F.lower(t).isin(SPECIAL) | t.rlike(LIMIT), F.lit(False))


def _comma_digits(x: Column) -> Column:
    """Digits behind a decimal comma, 0 if the text has no such form."""
    return F.coalesce(F.length(F.regexp_extract(F.trim(x), COMMA, 1)), F.lit(0))


def detection_limit_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_limits: strings that stand for a detection limit or a missing assay."""
    return _tidy(df, columns or string_columns(df), {"n_limits": (lambda c: F.count_if(is_detection_limit(col(c))), "long")})


def comma_decimal_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, definite, ambiguous: decimal commas; with three digits behind it may part thousands."""
    return _tidy(df, columns or string_columns(df), {
        "definite": (lambda c: F.count_if((_comma_digits(col(c)) > 0) & (_comma_digits(col(c)) != 3)), "long"),
        "ambiguous": (lambda c: F.count_if(_comma_digits(col(c)) == 3), "long"),
    })


def validate_geology(df: DataFrame) -> DataFrame:
    """check, column, n of every issue found: missing column classes, limits and commas in text, negatives, duplicates."""
    kinds, spark = classify_columns(df), df.sparkSession
    absent = [("missing_column", k, 1) for k in ("hole_id", "lat", "lon", "geochem") if k not in kinds]
    out = spark.createDataFrame(absent, "check string, column string, n long")
    text, numbers = set(string_columns(df)), set(numeric_columns(df))
    counts = []
    for c in df.columns:
        assay = classify_column(c) == "geochem"
        if c in text:
            counts.append(("comma_decimals", c, (_comma_digits(col(c)) > 0) & (_comma_digits(col(c)) != 3)))
            counts.append(("ambiguous_commas", c, _comma_digits(col(c)) == 3))
            if assay:
                counts.append(("detection_limits", c, is_detection_limit(col(c))))
        elif c in numbers and assay:
            counts.append(("negative_values", c, col(c) < 0))
    for i in range(0, len(counts), CHUNK):
        cells = [F.struct(F.lit(k).alias("check"), F.lit(c).alias("column"), F.count_if(test).alias("n")) for k, c, test in counts[i : i + CHUNK]]
        out = out.union(df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    copies = duplicate_counts(df, [df.columns])
    out = out.union(copies.select(F.lit("duplicate_rows"), F.lit("*"), "duplicates"))
    depth = next((c for c in df.columns if c.lower() in DEPTH_NAMES), None)
    if depth and "hole_id" in kinds:
        pair = duplicate_counts(df, [[kinds["hole_id"][0], depth]])
        out = out.union(pair.select(F.lit("duplicate_intervals"), "subset", "duplicates"))
    return out.where("n > 0")


def detect_cleaning_issues(df: DataFrame) -> DataFrame:
    """One row for each column: dtype, class, nulls; for text distinct values, limits, commas and (assays) what is no
    number; for numbers interquartile outliers, min, max and (assays) negatives. Quartiles take a pass of their own."""
    text, numbers, dtypes = set(string_columns(df)), set(numeric_columns(df)), dict(df.dtypes)
    quartiles = order_statistics(df, {c: col(c) for c in df.columns if c in numbers}, [0.25, 0.75])
    rows = df
    null_long, null_double = F.max(F.lit(None).cast("long")), F.max(F.lit(None).cast("double"))

    def of(kinds: set, f, none=null_long, assay: bool = False):
        return lambda c: f(c) if c in kinds and (not assay or classify_column(c) == "geochem") else none

    def odd(c: str) -> Column:
        low, high = quartiles[c]
        if low is None:
            return F.count_if(F.lit(False))
        spread = 1.5 * (high - low)
        return F.count_if((col(c) < low - spread) | (col(c) > high + spread))

    def unparsed(c: str) -> Column:
        t = F.trim(col(c))
        return F.count_if(t.isNotNull() & ~is_detection_limit(col(c)) & ~F.replace(t, F.lit(","), F.lit(".")).rlike(PLAIN))

    return _tidy(rows, df.columns, {
        "dtype": (lambda c: F.max(F.lit(dtypes[c])), "string"),
        "kind": (lambda c: F.max(F.lit(classify_column(c))), "string"),
        "nulls": (lambda c: F.count_if(col(c).isNull()), "long"),
        "n_distinct": (of(text, lambda c: F.count_distinct(col(c))), "long"),
        "n_limits": (of(text, lambda c: F.count_if(is_detection_limit(col(c)))), "long"),
        "n_commas": (of(text, lambda c: F.count_if((_comma_digits(col(c)) > 0) & (_comma_digits(col(c)) != 3))), "long"),
        "n_ambiguous": (of(text, lambda c: F.count_if(_comma_digits(col(c)) == 3)), "long"),
        "n_unparsed": (of(text, unparsed, assay=True), "long"),
        "n_outliers": (of(numbers, odd), "long"),
        "min": (of(numbers, lambda c: F.min(col(c).cast("double")), null_double), "double"),
        "max": (of(numbers, lambda c: F.max(col(c).cast("double")), null_double), "double"),
        "n_negative": (of(numbers, lambda c: F.count_if(col(c) < 0), assay=True), "long"),
    })


def fix_decimals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Decimal commas with other than three digits behind become points; other cells stay, and the column stays text.

    Without columns those are fixed in which a first pass finds such a comma; columns that aren't text are left alone.
    """
    columns = comma_columns(df) if columns is None else columns
    require(df, columns)
    text = set(string_columns(df))
    columns = [c for c in columns if c in text]
    fixed = lambda c: F.when((_comma_digits(col(c)) > 0) & (_comma_digits(col(c)) != 3), F.replace(F.trim(col(c)), F.lit(","), F.lit("."))).otherwise(col(c))
    return df.withColumns({c: fixed(c) for c in columns})


def comma_columns(df: DataFrame) -> list[str]:
    """Text columns with at least one certain decimal comma; one aggregated row reaches the driver."""
    return [r["column"] for r in comma_decimal_counts(df).where("definite > 0").collect()] if string_columns(df) else []


def parsed_limit(x: Column, method: str = "half") -> Column:
    """Number of an assay text: words for missing are null, below-limit values a half, zero or the limit itself."""
    if method not in ("half", "zero", "value"):
        raise ValueError(f"method must be half, zero or value, not {method!r}")
    t = F.trim(x)
    sign, limit = F.regexp_extract(t, LIMIT, 1), F.regexp_extract(t, LIMIT, 2).try_cast("double")
    below = {"half": limit / 2, "zero": F.when(limit.isNotNull(), 0.0), "value": limit}[method]
    out = F.when(F.lower(t).isin(SPECIAL), None).when(sign.isin("<", "≤", "<="), below).when(sign.isin(">", "≥", ">="), limit)
    return out.otherwise(F.when(t.rlike(PLAIN), t.try_cast("double")))


def parse_detection_limits(df: DataFrame, columns: list[str], method: str = "half") -> DataFrame:
    """The columns as numbers; numeric ones stay as they are."""
    require(df, columns)
    text = set(string_columns(df))
    return df.withColumns({c: parsed_limit(col(c), method) for c in columns if c in text})


def limit_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, below, above, special, parse_error of text columns."""
    sign = lambda c: F.regexp_extract(F.trim(col(c)), LIMIT, 1)
    special = lambda c: F.coalesce(F.lower(F.trim(col(c))).isin(SPECIAL), F.lit(False))
    return _tidy(df, columns, {
        "below": (lambda c: F.count_if(sign(c).isin("<", "≤", "<=")), "long"),
        "above": (lambda c: F.count_if(sign(c).isin(">", "≥", ">=")), "long"),
        "special": (lambda c: F.count_if(special(c)), "long"),
        "parse_error": (lambda c: F.count_if(col(c).isNotNull() & ~special(c) & parsed_limit(col(c), "value").isNull()), "long"),
    })


def standard_term(x: Column, mapping: dict[str, str] | None = None) -> Column:
    if not mapping:
        return F.regexp_replace(F.trim(x), r"\s+", " ")
    pairs = F.create_map(*[F.lit(v) for k, m in mapping.items() for v in (k.strip().lower(), m)])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(x))), F.trim(x))


def standardize_terms(df: DataFrame, columns: list[str], mapping: dict[str, str] | None = None) -> DataFrame:
    """Trimmed terms: without a mapping inner white space collapses; with one, terms are looked up without case."""
    require(df, columns)
    return df.withColumns({c: standard_term(col(c), mapping) for c in columns})


def term_report(df: DataFrame, columns: list[str], mapping: dict[str, str] | None = None) -> DataFrame:
    """column, changed, distinct_before, distinct_after of standardize_terms."""
    return _tidy(df, columns, {
        "changed": (lambda c: F.count_if(~col(c).eqNullSafe(standard_term(col(c), mapping))), "long"),
        "distinct_before": (lambda c: F.count_distinct(col(c)), "long"),
        "distinct_after": (lambda c: F.count_distinct(standard_term(col(c), mapping)), "long"),
    })
