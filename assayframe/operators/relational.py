"""Joins, grouping, reshaping and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, numeric_columns, require
from .graph import keep
from .rowid import with_row_id
from .selection import grouped_quantiles

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


#: Rows of a sample in which hot keys are looked for, and how often they are there at least. A key is hot if it has more
#: than 1 / FINE of an average partition's rows, or more than PAIRS pairs of rows; a task joins about PAIRS at most.
SAMPLED, OFTEN, FINE, PAIRS = 200_000, 16, 4, 1 << 25


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on shared names in which null keys match null keys.

    Keys appear once (coalesced for outer and right joins); other shared names get _x and _y. Spark splits large partitions
    at run time by their bytes, those of an outer join on one side only or not at all, and never by the pairs they make:
    hot keys are spread here (see _spread).
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {', '.join(HOW)}, not {how!r}")
    require(left, on)
    require(right, on)
    shared = {c for c in left.columns if c in right.columns and c not in on}
    a = left.select(*[col(c).alias(f"k{i}") for i, c in enumerate(on)], *[col(c).alias(f"{c}_x" if c in shared else c) for c in left.columns if c not in on])
    b = right.select(*[col(c).alias(f"j{i}") for i, c in enumerate(on)], *[col(c).alias(f"{c}_y" if c in shared else c) for c in right.columns if c not in on])
    out = _spread(a, b, len(on), HOW[how])
    return out.select(*[F.coalesce(f"k{i}", f"j{i}").alias(c) for i, c in enumerate(on)], *[col(c) for c in [*a.columns[len(on) :], *b.columns[len(on) :]]])


def _often(rows: DataFrame, keys: list[str], common: list[str], n: int) -> DataFrame:
    """Keys that a sample has OFTEN: no more than SAMPLED / OFTEN."""
    some = rows.select(*[F.col(k).alias(c) for k, c in zip(keys, common)]).sample(min(1.0, SAMPLED / max(n, 1)), seed=3)
    return some.groupBy(*common).agg(F.count("*").alias("_n")).where(F.col("_n") >= OFTEN).select(*common)


def _same(rows: DataFrame, keys: list[str], common: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [rows[k].eqNullSafe(F.col(c)) for k, c in zip(keys, common)])


def _hot(a: DataFrame, b: DataFrame, n: int, parts: int) -> DataFrame:
    """Hot keys (_h0, ..), their rows on both sides (_na, _nb), and into how many parts each side is cut (_sa, _sb), so that
    no cell of a part of a with a part of b has too many rows or pairs. A key that one side lacks has no cells but parts."""
    common = [f"_h{i}" for i in range(n)]
    sides = [(a, [f"k{i}" for i in range(n)], "_na"), (b, [f"j{i}" for i in range(n)], "_nb")]
    sizes = [rows.count() for rows, _, _ in sides]
    maybe = keep(reduce(DataFrame.union, [_often(rows, keys, common, size) for (rows, keys, _), size in zip(sides, sizes)]).distinct())
    # the counts of these few keys are exact
    counts = [rows.join(F.broadcast(maybe), _same(rows, keys, common)).groupBy(*common).agg(F.count("*").alias(name)) for rows, keys, name in sides]
    counts = [c.select(*common, *[F.col(x) if x in c.columns else F.lit(0).cast("long").alias(x) for x in ("_na", "_nb")]) for c in counts]
    hot = counts[0].union(counts[1]).groupBy(*common).agg(F.sum("_na").alias("_na"), F.sum("_nb").alias("_nb"))
    most = [F.lit(max(size / (FINE * parts), 1.0)) for size in sizes]
    pairs = F.col("_na").cast("double") * F.col("_nb")
    cells = F.ceil(pairs / PAIRS)
    hot = hot.where((F.col("_na") > most[0]) | (F.col("_nb") > most[1]) | (cells > 1))
    # as many parts of each side as make the fewest copies
    even = F.when((F.col("_na") > 0) & (F.col("_nb") > 0), F.sqrt(cells * F.col("_na") / F.col("_nb"))).otherwise(F.lit(1.0))
    hot = hot.withColumn("_sa", F.ceil(F.greatest(F.least(even, cells), F.col("_na") / most[0], F.lit(1.0))).cast("int"))
    return hot.withColumn("_sb", F.ceil(F.greatest(cells / F.col("_sa"), F.col("_nb") / most[1], F.lit(1.0))).cast("int"))


def _spread(a: DataFrame, b: DataFrame, n: int, how: str) -> DataFrame:
    """The join of a (k0, ..) and b (j0, ..), with hot keys in many tasks whatever the kind of join.

    The rows of a hot key that both sides have are cut into parts, and each part of a meets each part of b in a cell of its
    own; there every row has a partner, so the cells are inner joins. All other rows are joined as asked; those of a hot key
    without partners carry a salt, which keeps them apart.
    """
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = {"a": [f"k{i}" for i in range(n)], "b": [f"j{i}" for i in range(n)]}
    common = [f"_h{i}" for i in range(n)]
    test = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(j)) for k, j in zip(names["a"], names["b"])])
    hot = keep(_hot(a, b, n, parts))
    if hot.isEmpty():
        return a.join(b, test, how)
    order = Window.orderBy(*common).rowsBetween(Window.unboundedPreceding, -1)  # a few keys
    size = F.when((F.col("_na") > 0) & (F.col("_nb") > 0), F.col("_sa") * F.col("_sb")).otherwise(0)
    hot = keep(hot.withColumn("_first", F.when(size > 0, F.coalesce(F.sum(size).over(order), F.lit(0)))))
    total = hot.agg(F.sum(size)).first()[0]

    def marked(rows: DataFrame, side: str) -> DataFrame:
        out = rows.join(F.broadcast(hot), _same(rows, names[side], common), "left")
        return out.withColumn("_p", F.pmod(F.monotonically_increasing_id(), F.coalesce(f"_s{side}", F.lit(1))).cast("int"))

    left, right = marked(a, "a"), marked(b, "b")
    rest = left.where("_first IS NULL").select(*a.columns, F.col("_p").alias("_pa")).join(right.where("_first IS NULL").select(*b.columns, F.col("_p").alias("_pb")), test & (F.col("_pa") == F.col("_pb")), how)
    rest = rest.select(*a.columns, *b.columns)
    if not total:
        return rest
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    of_a = F.transform(upto("_sb"), lambda j: F.col("_first") + F.col("_p") * F.col("_sb") + j)
    of_b = F.transform(upto("_sa"), lambda i: F.col("_first") + i * F.col("_sb") + F.col("_p"))
    left = left.where("_first IS NOT NULL").select(*a.columns, F.explode(of_a).alias("_cell"))
    right = right.where("_first IS NOT NULL").select(*b.columns, F.explode(of_b).alias("_at"))
    # a number of partitions of its own, as Spark would put cells together by their few bytes
    tasks = max(parts, min(total, 20_000))
    cells = left.repartition(tasks, "_cell").join(right.repartition(tasks, "_at"), F.col("_cell") == F.col("_at"))
    return rest.union(cells.select(*a.columns, *b.columns))


STATISTICS = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "max": F.max, "min": F.min, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0))}


def _grouped(df: DataFrame, keys: list[str], statistic: str, skip: list[str]) -> DataFrame:
    values = [c for c in numeric_columns(df) if c not in keys and c not in skip]
    for k in keys:
        df = df.where(col(k).isNotNull())
    groups = df.groupBy(*[col(k) for k in keys])
    if statistic == "count":
        if not values:
            raise ValueError("there is no numeric column to count")
        return groups.agg(F.count(col(values[0])).alias("count"))
    if statistic not in STATISTICS:
        raise ValueError(f"unknown statistic {statistic!r}")
    if statistic == "median":
        return grouped_quantiles(df, keys, values)
    return groups.agg(*[STATISTICS[statistic](col(c)).alias(c) for c in values])


def aggregate_grid(df: DataFrame, resolution: float, statistic: str = "mean", x_col: str = "Easting", y_col: str = "Northing") -> DataFrame:
    """The statistic of every other numeric column in square cells; x_bin, y_bin are multiples of the resolution.

    Halves go to the even multiple; rows without coordinates are left out; count is of the first value column.
    """
    require(df, [x_col, y_col])
    if resolution <= 0:
        raise ValueError("the resolution must be positive")
    cell = lambda c: F.rint(col(c).cast("double") / resolution) * resolution
    names = [f"{x_col}_bin", f"{y_col}_bin"]
    return _grouped(df.withColumns({names[0]: cell(x_col), names[1]: cell(y_col)}), names, statistic, [x_col, y_col])


def aggregate_by(df: DataFrame, column: str, statistic: str = "mean", skip: list[str] | None = None) -> DataFrame:
    """The statistic of every numeric column (but those to skip) by the values of a column; a null value is left out."""
    require(df, [column])
    return _grouped(df, [column], statistic, skip or [])


#: Columns up to which pivot makes them of keys it looks for.
WIDEST = 10_000
#: Aggregates of pivot; of these the SUMS have a value where all cells are null.
AGGREGATES = STATISTICS | {"count": F.count, "nunique": F.count_distinct, "std": F.stddev_samp, "var": F.var_samp}
SUMS = ["sum", "count", "nunique"]


def pivot(df: DataFrame, index: list[str], columns: str, values: list[str], keys: list | None = None, aggfunc: str = "first", order_by: str | None = None) -> DataFrame:
    """Long to wide: columns {value}_{key} for each value and key, sorted; rows without index or key are left out.

    first and last take the first and last non-null value by order_by. Listing the keys spares a pass that looks for
    them (an error beyond WIDEST keys); keys that are looked for give no column, and index values no row, that would be null throughout.
    """
    require(df, [*index, columns, *values])
    if aggfunc in ("first", "last"):
        if not order_by:
            raise ValueError(f"{aggfunc} needs order_by")
        pick = F.min_by if aggfunc == "first" else F.max_by
        f = lambda v: pick(v, F.when(v.isNotNull(), col(order_by)))
    elif aggfunc in AGGREGATES:
        f = AGGREGATES[aggfunc]
    else:
        raise ValueError(f"unknown aggregate {aggfunc!r}")
    rows = df.where(col(columns).isNotNull())
    for i in index:
        rows = rows.where(col(i).isNotNull())
    if keys is None:
        # one row for each column of the result reaches the driver, and no more than WIDEST
        if rows.select(col(columns)).distinct().limit(WIDEST + 1).count() > WIDEST:
            raise ValueError(f"{columns} has more than {WIDEST} keys: list those to be columns")
        found = rows.groupBy(col(columns).alias("key")).agg(*[F.count(col(v)).alias(f"n{j}") for j, v in enumerate(values)]).collect()
        cells = sorted((v, r["key"]) for r in found for j, v in enumerate(values) if r[f"n{j}"] or aggfunc in SUMS)
    else:
        cells = [(v, k) for v in sorted(values) for k in sorted(keys)]
    out = rows.groupBy(*[col(i) for i in index]).agg(*[f(F.when(col(columns) == k, col(v))).alias(f"{v}_{k}") for v, k in cells] or [F.lit(None).alias("_none")])
    if not cells:
        return out.select(*[col(i) for i in index]).limit(0)
    if keys is None and aggfunc not in SUMS:
        out = out.where(reduce(lambda a, b: a | b, [col(f"{v}_{k}").isNotNull() for v, k in cells]))
    return out


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long, nulls kept; values of different types become double if all are numbers, else text."""
    require(df, [*ids, *values])
    kinds = {df.schema[v].dataType for v in values}
    common = None if len(kinds) == 1 else "double" if set(values) <= set(numeric_columns(df)) else "string"
    cells = [col(v).cast(common).alias(v) if common else col(v) for v in values]
    return df.select(*[col(i) for i in ids], *cells).unpivot([col(i) for i in ids], [col(v) for v in values], variable, value)


def remove_duplicates(df: DataFrame, order_by: list[str], subset: list[str] | None = None, keep: str = "first") -> DataFrame:
    """Rows less their duplicates on the subset (all columns by default); nulls are equal; keep first, last or none.

    Aggregation instead of a window: a key that very many rows share is combined before the shuffle.
    """
    keys = subset or df.columns
    require(df, [*keys, *order_by])
    groups = df.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    row, place = F.struct(*[col(c).alias(f"_{i}") for i, c in enumerate(df.columns)]), F.struct(*[col(o) for o in order_by])
    if keep == "none":
        out = groups.agg(F.count("*").alias("_n"), F.any_value(row).alias("_r")).where("_n = 1")
    elif keep in ("first", "last"):
        out = groups.agg((F.min_by if keep == "first" else F.max_by)(row, place).alias("_r"))
    else:
        raise ValueError(f"keep must be first, last or none, not {keep!r}")
    return out.select(*[F.col("_r")[f"_{i}"].alias(c) for i, c in enumerate(df.columns)])


def duplicate_counts(df: DataFrame, subsets: list[list[str]]) -> DataFrame:
    """subset (names joined by commas), duplicates: rows beyond the first of each key."""
    out = None
    for keys in subsets:
        require(df, keys)
        one = df.groupBy(*[col(k) for k in keys]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
        one = one.select(F.lit(",".join(keys)).alias("subset"), "duplicates")
        out = one if out is None else out.union(one)
    return out


def smooth(df: DataFrame, column: str, window: int, method: str = "mean", *, order_by: list[str], partition_by: list[str] | None = None, bucket: int = 65536, row_id: str | None = None) -> DataFrame:
    """{column}_smooth: centred mean or median over ``window`` rows, null where fewer than that many values are present.

    An even window has window // 2 rows before and (window - 1) // 2 after. Rows are numbered in the order of partition and
    order columns (row_id is such a number, where there is one), and the numbers are cut into buckets with a halo of
    neighbours. So no window holds the whole table, nor all rows of a partition key: a key that every row has is spread
    over as many tasks as it fills buckets, while many small keys share one.
    """
    keys = partition_by or []
    require(df, [column, *order_by, *keys])
    if method not in ("mean", "median"):
        raise ValueError(f"method must be mean or median, not {method!r}")
    before, after = window // 2, (window - 1) // 2
    rows = df if row_id and not keys else with_row_id(df, [*keys, *order_by], "_id")
    at = col(row_id if row_id and not keys else "_id")
    low, high = F.floor((at - after) / bucket), F.floor((at + before) / bucket)
    home = F.floor(at / bucket)
    spread = rows.withColumn("_b", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    # the rows of other keys in a bucket are in windows of their own
    w = Window.partitionBy("_b", *[col(k) for k in keys]).orderBy(at).rowsBetween(-before, after)
    x = F.avg(col(column)) if method == "mean" else F.percentile(col(column), F.lit(0.5))
    out = spread.withColumn(f"{column}_smooth", F.when(F.count(col(column)).over(w) == window, x.over(w)))
    return out.where(F.col("_b") == home).select(*df.columns, f"{column}_smooth")
