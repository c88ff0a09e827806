"""Numeric claims checked against data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, numeric_columns, string_columns
from .graph import keep
from .selection import order_statistics

AGGREGATES = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "std": F.stddev_samp,
}
OPERATIONS = ["exact", "count", *AGGREGATES, "median"]
DEFAULT_TOLERANCE = 0.01
#: Claimed values that one scan looks for, and rows of a block of the index.
FEW, BLOCK = 10_000, 256
ACTUALS = "claim_id, actual, n"


def _error(actual: Column, claimed: Column) -> Column:
    """Relative error; for a claim of 0 the absolute value."""
    return F.when(claimed == 0, F.abs(actual)).otherwise(F.try_divide(F.abs(actual - claimed), F.abs(claimed)))


def _whole(df: DataFrame, plain: DataFrame, used: dict[str, set[str]]) -> tuple[DataFrame, dict[str, float]]:
    """(claim_id, actual, n) of claims on whole columns (exact ones apart), from one aggregation and, for medians, exact
    selection; and the columns' means."""
    names = list(used)
    stats = df.agg(F.count("*").alias("_rows"), *[f(col(n)).cast("double").alias(f"{k}|{n}") for n in names for k, f in AGGREGATES.items()]).first()
    rows = [(n, k, stats[f"{k}|{n}"], stats["_rows"]) for n in names for k in AGGREGATES] + [(n, "count", float(stats["_rows"]), stats["_rows"]) for n in names]
    middle = order_statistics(df, {n: col(n) for n in names if "median" in used[n]}, [0.5])
    rows += [(n, "median", q[0], stats["_rows"]) for n, q in middle.items()]
    table = df.sparkSession.createDataFrame(rows, "column string, operation string, actual double, n long")
    return plain.join(F.broadcast(table), ["column", "operation"]).select("claim_id", "actual", "n"), {n: stats[f"mean|{n}"] or 0.0 for n in names}


def _nearest(df: DataFrame, exact: DataFrame) -> DataFrame:
    """(claim_id, actual, n): the value of the claimed column that is nearest to the claim, of two the smaller.

    Claimed values go to the tasks, FEW to a scan; a task looks them up in its sorted batches and sends one candidate each.
    """
    asked = exact.select("column", "claimed").distinct()
    out = None
    for part in _rounds(asked, FEW):
        names = sorted({r["column"] for r in part})
        wanted = {n: np.array(sorted(r["claimed"] for r in part if r["column"] == n)) for n in names}

        def look(batches: Iterator[pa.RecordBatch], names: list = names, wanted: dict = wanted) -> Iterator[pa.RecordBatch]:
            best = {n: np.full(len(wanted[n]), np.nan) for n in names}
            for b in batches:
                for k, n in enumerate(names):
                    x = np.sort(b.column(k).drop_null().to_numpy(zero_copy_only=False))
                    if not len(x):
                        continue
                    at = np.searchsorted(x, wanted[n])
                    for found in (x[np.maximum(at - 1, 0)], x[np.minimum(at, len(x) - 1)]):
                        d, own = np.abs(found - wanted[n]), np.abs(best[n] - wanted[n])
                        best[n] = np.where(np.isnan(best[n]) | (d < own) | ((d == own) & (found < best[n])), found, best[n])
            for n in names:
                some = ~np.isnan(best[n])
                yield pa.RecordBatch.from_arrays([pa.array([n] * int(some.sum()), pa.string()), pa.array(wanted[n][some]), pa.array(best[n][some])], names=["column", "claimed", "v"])

        found = df.select(*[col(n).cast("double").alias(f"c{k}") for k, n in enumerate(names)]).mapInArrow(look, "column string, claimed double, v double")
        found = found.groupBy("column", "claimed").agg(F.min_by("v", F.struct(F.abs(F.col("v") - F.col("claimed")), "v")).alias("actual"))
        out = found if out is None else out.union(found)
    return exact.join(out, ["column", "claimed"]).select("claim_id", "actual", F.lit(None).cast("long").alias("n"))


def _rounds(rows: DataFrame, size: int) -> Iterator[list]:
    """The rows in lists of one size, which reach the driver one after the other."""
    part = []
    for r in rows.toLocalIterator():
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def _ranges(df: DataFrame, row_id: str, claims: DataFrame, names: list[str], means: dict[str, float], total: int) -> DataFrame:
    """(claim_id, actual, n) of claims on row ranges (claim_id, column, operation, claimed, lo, hi).

    Rows are aggregated to blocks of BLOCK row numbers and these to blocks twice as long, and so on. A range is made of the
    longest blocks that fit in it, two of each length at most, and of the rows at its ends outside of them: what is joined
    for a claim follows the logarithm of its length. Only medians and exact values need all rows of their range.
    """
    long = df.select(col(row_id).cast("long").alias("at"), *[col(n).cast("double").alias(n) for n in names]).unpivot(["at"], [col(n) for n in names], "column", "v")
    shift = F.coalesce(*[F.when(F.col("column") == n, F.lit(float(means[n]))) for n in names])
    rows = long.withColumns({"block": F.floor(F.col("at") / BLOCK), "d": F.col("v") - shift})
    sums = [F.count("*").alias("n"), F.count("v").alias("k"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"), F.min("v").alias("low"), F.max("v").alias("high")]
    again = [F.sum(c).alias(c) for c in ("n", "k", "s", "q")] + [F.min("low").alias("low"), F.max("high").alias("high")]
    levels = max(1, (total // BLOCK + 1).bit_length())

    whole = claims.where("operation NOT IN ('median', 'exact')").withColumns({"a": F.expr(f"(lo + {BLOCK - 1}) DIV {BLOCK}"), "b": F.expr(f"(hi + 1) DIV {BLOCK}")})
    first, last = "-shiftright(-a, k)", "shiftright(b, k)"
    pieces = F.expr(f"""flatten(transform(sequence(0, {levels}), k -> CASE WHEN {first} < {last} THEN array_compact(array(
        CASE WHEN ({first}) % 2 = 1 THEN struct(k AS level, {first} AS block) END, CASE WHEN {last} % 2 = 1 THEN struct(k AS level, {last} - 1 AS block) END))
        ELSE array() END))""")
    covered = whole.select("claim_id", "column", F.explode(pieces).alias("p")).select("claim_id", "column", "p.level", "p.block")
    base = rows.groupBy("column", "block").agg(*sums)
    tree = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("block", F.expr("shiftright(block, level)")).groupBy("column", "level", "block").agg(*again)
    of_blocks = covered.join(tree, ["column", "level", "block"]).select("claim_id", "n", "k", "s", "q", "low", "high")

    ends = F.array_distinct(F.array(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK)))
    border = whole.select("claim_id", "column", "lo", "hi", "a", "b", F.explode(ends).alias("block")).where("NOT (a <= block AND block < b)")
    of_rows = rows.join(border, ["column", "block"]).where("at BETWEEN lo AND hi").groupBy("claim_id").agg(*sums)
    found = of_blocks.unionByName(of_rows.select(*of_blocks.columns)).groupBy("claim_id").agg(*again)
    found = found.join(whole.select("claim_id", "column", "operation"), "claim_id").withColumn("m", shift)
    value = (
        F.when(F.col("operation") == "count", F.col("n").cast("double"))
        .when(F.col("k") == 0, None)
        .when(F.col("operation") == "mean", F.col("m") + F.try_divide(F.col("s"), F.col("k")))
        .when(F.col("operation") == "sum", F.col("m") * F.col("k") + F.col("s"))
        .when(F.col("operation") == "min", F.col("low"))
        .when(F.col("operation") == "max", F.col("high"))
        .when(F.col("k") > 1, F.sqrt(F.greatest(F.try_divide(F.col("q") - F.try_divide(F.col("s") * F.col("s"), F.col("k")), F.col("k") - 1), F.lit(0.0))))
    )
    out = found.select("claim_id", value.alias("actual"), "n")

    read = claims.where("operation IN ('median', 'exact')")
    read = read.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))))
    v = F.col("v")
    nearest = F.min_by(v, F.when(v.isNotNull(), F.struct(F.abs(v - F.col("claimed")), v)))
    of_rows = rows.join(read, ["column", "block"]).where("at BETWEEN lo AND hi").groupBy("claim_id", "operation")
    of_rows = of_rows.agg(F.percentile(v, F.lit(0.5)).alias("median"), nearest.alias("exact"), F.count("*").alias("n"))
    return out.union(of_rows.select("claim_id", F.when(F.col("operation") == "median", F.col("median")).otherwise(F.col("exact")).alias("actual"), "n"))


def verify_claims(df: DataFrame, claims: DataFrame, row_id: str | None = None) -> DataFrame:
    """claim_id, status (verified, failed, not_found), reason, actual (6 places), relative_error (4 places).

    claims: claim_id, value, column, operation, rows (first and last row number from 0, inclusive, or null), tolerance
    (0.01 if null), and optionally text: the value that an exact claim on a text column says is there. count counts rows
    with nulls too; exact takes the nearest value of a number column, of two the smaller.

    Statistics of whole columns come from one aggregation; nearest values are looked up in the tasks; ranges are put
    together from an index of blocks, so the work follows rows and claims, and not their product.
    """
    has_text = "text" in claims.columns
    if not has_text:
        claims = claims.withColumn("text", F.lit(None).cast("string"))
    numeric, text = numeric_columns(df), string_columns(df)
    of_text = F.col("column").isin(text) if text else F.lit(False)
    known = F.col("column").isin([*numeric, *text]) if numeric or text else F.lit(False)
    member = F.coalesce((F.col("operation") == "exact") & F.col("text").isNotNull() & of_text, F.lit(False))
    total = df.count()
    beyond = F.col("rows").isNotNull() & ((F.col("rows")[0] < 0) | (F.col("rows")[1] >= total) | (F.col("rows")[0] > F.col("rows")[1]))
    missing = (F.col("value").isNull() & ~member) | F.col("column").isNull() | F.col("operation").isNull()
    reason = F.when(missing, "missing field").when(~known, "unknown column").when(~F.col("operation").isin(OPERATIONS), "unknown operation").when(of_text & ~member, "not a number column")
    c = claims.withColumn("member", member).withColumn("reason", F.coalesce(reason, F.when(F.coalesce(beyond, F.lit(False)), "range out of bounds")))
    usable = keep(c.where("reason IS NULL AND NOT member").select("claim_id", "column", "operation", F.col("value").alias("claimed"), F.col("rows")[0].alias("lo"), F.col("rows")[1].alias("hi")))
    used: dict[str, dict[str, set]] = {"whole": {}, "range": {}}
    for r in usable.select("column", "operation", F.col("lo").isNotNull().alias("ranged")).distinct().collect():  # columns and operations are few
        used["range" if r["ranged"] else "whole"].setdefault(r["column"], set()).add(r["operation"])
    found = df.sparkSession.createDataFrame([], "claim_id long, actual double, n long").select(F.col("claim_id").cast(claims.schema["claim_id"].dataType), "actual", "n")
    means: dict[str, float] = {}
    if every := {n: used["whole"].get(n, set()) for n in [*used["whole"], *used["range"]]}:
        whole, means = _whole(df, usable.where("lo IS NULL AND operation <> 'exact'"), every)
        found = found.union(whole)
    if any("exact" in x for x in used["whole"].values()):
        found = found.union(_nearest(df, usable.where("lo IS NULL AND operation = 'exact'")))
    if used["range"]:
        if not row_id:
            raise ValueError("claims on row ranges need row_id, the name of a column of row numbers")
        found = found.union(_ranges(df, row_id, usable.where("lo IS NOT NULL"), list(used["range"]), means, total))
    found = c.join(found, "claim_id", "left")
    members = verify_members(df, claims.where("text IS NOT NULL").select("claim_id", "column", F.col("text").alias("value"))) if has_text and text else None
    found = found.join(members, "claim_id", "left") if members is not None else found.withColumn("found", F.lit(False))
    reason = F.coalesce("reason", F.when(F.col("actual").isNull(), "no values"))
    tolerance = F.coalesce("tolerance", F.lit(DEFAULT_TOLERANCE))
    error = _error(F.col("actual"), F.col("value"))
    fits = F.when(F.col("value") == 0, (F.col("actual") == 0) | (F.abs("actual") < tolerance)).otherwise(error <= tolerance)
    reason = F.when(F.col("member"), F.when(~F.coalesce("found", F.lit(False)), "no such value")).otherwise(reason)
    status = F.when(reason.isNotNull(), "not_found").when(F.col("member") | fits, "verified").otherwise("failed")
    shown = lambda x: F.when(reason.isNull(), x)
    return found.select("claim_id", status.alias("status"), reason.alias("reason"), shown(F.round("actual", 6)).alias("actual"), shown(F.round(error, 4)).alias("relative_error"))


def verify_members(df: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_id, found: whether a text column (claims: claim_id, column, value) has the value.

    Only columns that a claim names are read, and only values that one asks for go on.
    """
    text = set(string_columns(df))
    named = sorted(text & {r["column"] for r in claims.select("column").distinct().collect()})
    if not named:
        return claims.select("claim_id", F.lit(False).alias("found"))
    long = df.select(*[col(c) for c in named]).unpivot([], [col(c) for c in named], "column", "value").where("value IS NOT NULL")
    asked = claims.select("column", "value").distinct()
    there = long.join(asked, ["column", "value"], "left_semi").distinct()
    return claims.join(there.withColumn("found", F.lit(True)), ["column", "value"], "left").select("claim_id", F.coalesce("found", F.lit(False)).alias("found"))
