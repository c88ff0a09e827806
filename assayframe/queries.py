"""Registered queries of the core operators over the driver's tables, and the same in DuckDB SQL.

Numeric tables hold no nulls, so queries about nulls make them from the data by the same rule on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as p
from .operators import anomaly as an
from .operators import cleaning, crs, derive, filters, hypotheses, ml, plotdata, profile, raster, relational, rowid, verify
from .operators.graph import keep
from .plans.flagship import anomalous_groups
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str | None, query: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


# ---- assay-like text, made from numbers by one rule for both engines ----
ASSAY = """CASE WHEN l_linenumber = 1 THEN '<' || CAST(CAST(l_quantity AS INT) AS {s})
    WHEN l_linenumber = 2 AND l_quantity > 25 THEN 'ND' WHEN l_linenumber = 3 AND l_quantity > 40 THEN '> ' || CAST(CAST(l_quantity AS INT) AS {s})
    WHEN l_linenumber = 4 AND l_quantity < 10 THEN CAST(CAST(l_quantity AS INT) AS {s}) || ',25'
    WHEN l_linenumber = 4 AND l_quantity < 20 THEN CAST(CAST(l_quantity AS INT) AS {s}) || ',125'
    WHEN l_linenumber = 5 AND l_quantity < 5 THEN ' trace ' WHEN l_linenumber = 5 AND l_quantity < 8 THEN 'abc'
    ELSE CAST(CAST(l_quantity AS INT) AS {s}) || '.5' END"""
TERM = "CASE WHEN l_linenumber % 3 = 0 THEN '  ' || l_returnflag || '   x ' WHEN l_linenumber % 3 = 1 THEN lower(l_returnflag) ELSE l_returnflag END"


def _assays(t) -> DataFrame:
    return t("lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", f"{ASSAY.format(s='STRING')} AS Au_ppm", f"{TERM} AS lithology")


ASSAYS = f"(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, {ASSAY.format(s='VARCHAR')} AS Au_ppm, {TERM} AS lithology FROM lineitem)"


def _events(t) -> DataFrame:
    """Events whose value is null for every seventh row."""
    return t("events").withColumn("value", F.expr("IF(event_id % 7 = 0, NULL, value)"))


EVENTS = "(SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value) FROM events)"

# ---- projection, derivation, filters ----
_add("select_columns", "SELECT l_orderkey, l_tax FROM lineitem", lambda t: derive.select_columns(t("lineitem"), ["l_orderkey", "l_tax"]))
_add("compute_ratios", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 9) AS l_extendedprice_over_l_quantity, round(l_discount / nullif(l_tax, 0), 9) AS l_discount_over_l_tax FROM lineitem",
     lambda t: _rounded(derive.compute_ratios(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"), ["l_extendedprice/l_quantity", "l_discount/l_tax"]).drop("l_extendedprice", "l_quantity", "l_discount", "l_tax"), "l_extendedprice_over_l_quantity", "l_discount_over_l_tax", places=9))
_add("log_transform", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) AS l_quantity_log FROM lineitem",
     lambda t: _rounded(derive.log_transform(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]), "l_quantity_log").drop("l_quantity"))
_add("log_transform_10", "SELECT l_orderkey, l_linenumber, round(log10(1 + l_quantity), 6) AS l_quantity_log10 FROM lineitem",
     lambda t: _rounded(derive.log_transform(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], "10"), "l_quantity_log10").drop("l_quantity"))
_add("standardize", f"SELECT event_id, round((coalesce(value, m) - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value_z FROM {EVENTS}, (SELECT avg(value) AS m, stddev_pop(coalesce(value, (SELECT avg(value) FROM {EVENTS}))) AS s FROM {EVENTS})",
     lambda t: _rounded(derive.standardize(_events(t).select("event_id", "value"), ["value"]), "value_z").drop("value"))
_add("normalize", f"SELECT event_id, round((coalesce(value, m) - lo) / (hi - lo), 6) AS value_norm FROM {EVENTS}, (SELECT avg(value) AS m, min(value) AS lo, max(value) AS hi FROM {EVENTS})",
     lambda t: _rounded(derive.normalize(_events(t).select("event_id", "value"), ["value"]), "value_norm").drop("value"))
_add("convert_dtype", f"SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(Au_ppm, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN try_cast(trim(Au_ppm) AS DOUBLE) END AS Au_ppm FROM {ASSAYS}",
     lambda t: derive.convert_dtype(_assays(t).select("l_orderkey", "l_linenumber", "Au_ppm"), "Au_ppm", "float"))
_add("convert_dtype_str", "SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey FROM orders", lambda t: derive.convert_dtype(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", "str"))
_add("convert_dtype_datetime", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN date_trunc('second', o_orderdate) END AS o_orderdate FROM orders",
     lambda t: derive.convert_dtype(t("orders").select("o_orderkey", F.expr("IF(o_orderkey % 3 = 0, 'no date', date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'))").alias("o_orderdate")), "o_orderdate", "datetime").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")))
_add("convert_dtype_raise", "SELECT o_orderkey, o_custkey FROM orders", lambda t: derive.convert_dtype(t("orders").select("o_orderkey", F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("o_custkey")), "o_custkey", "int", "raise"))
_add("convert_dtype_int", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem",
     lambda t: derive.convert_dtype(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "int"))
for name, op, value, sql in (
    ("filter_eq", "==", "3", "l_linenumber = 3"), ("filter_ne", "!=", "3", "l_linenumber <> 3"), ("filter_gt", ">", "4", "l_linenumber > 4"), ("filter_lt", "<", "2", "l_linenumber < 2"),
    ("filter_ge", ">=", "4", "l_linenumber >= 4"), ("filter_le", "<=", "2", "l_linenumber <= 2"), ("filter_in", "in", "1, 3,,5", "l_linenumber IN (1, 3, 5)"), ("filter_not_in", "not_in", "1, 3", "l_linenumber NOT IN (1, 3)"),
):
    _add(name, f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {sql}", lambda t, op=op, value=value: filters.filter_rows(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_linenumber", op, value))
_add("filter_contains", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)r.*T$')", lambda t: filters.filter_rows(t("part").select("p_partkey", "p_name"), "p_name", "contains", "r.*T$"))
_add("filter_not_null", f"SELECT event_id, value FROM {EVENTS} WHERE value IS NOT NULL", lambda t: filters.filter_rows(_events(t).select("event_id", "value"), "value", "not_null"))
_add("filter_report", 'SELECT count(*) AS before, count(*) FILTER (l_quantity > 30) AS "after", count(*) - count(*) FILTER (l_quantity > 30) AS removed FROM lineitem', lambda t: filters.filter_report(t("lineitem"), "l_quantity", ">", "30"))
_add("threshold", f"SELECT event_id, value FROM {EVENTS} WHERE value > 50", lambda t: filters.threshold(_events(t).select("event_id", "value"), "value", 50.0))
_add("threshold_below", f"SELECT event_id, value FROM {EVENTS} WHERE value < 20", lambda t: filters.threshold(_events(t).select("event_id", "value"), "value", 20.0, "below"))
_add("predicate_not", f"SELECT event_id FROM {EVENTS} WHERE NOT coalesce(value > 30, false)", lambda t: _events(t).where(p.not_(p.gt("value", 30))).select("event_id"))
_add("predicate_ne_null", f"SELECT event_id FROM {EVENTS} WHERE value IS NULL OR value <> 30", lambda t: _events(t).where(p.ne("value", 30)).select("event_id"))
_add("predicate_or_and", f"SELECT event_id FROM {EVENTS} WHERE (value BETWEEN 10 AND 20 OR value IS NULL) AND event_type IN ('click', 'view', 'purchase')", lambda t: _events(t).where(p.and_(p.or_(p.between("value", 10, 20), p.isna("value")), p.isin("event_type", ["click", "view", "purchase"]))).select("event_id"))
_add("predicate_contains", "SELECT p_partkey FROM part WHERE lower(p_type) LIKE 'std%' OR lower(p_type) LIKE '%a%'", lambda t: t("part").where(p.contains("p_type", "^STD|A", case=False)).select("p_partkey"))
_add("predicate_startswith", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'S') OR starts_with(p_name, 'red')", lambda t: t("part").where(p.or_(p.startswith("p_type", "S"), p.startswith("p_name", "red"))).select("p_partkey"))
_add("predicate_endswith", "SELECT p_partkey FROM part WHERE ends_with(p_name, 'ring') AND NOT ends_with(p_brand, '1')", lambda t: t("part").where(p.and_(p.endswith("p_name", "ring"), p.not_(p.endswith("p_brand", "1")))).select("p_partkey"))
_add("predicate_arithmetic", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE floor(l_quantity / 7) % 2 = 1 AND l_quantity - 7 * floor(l_quantity / 7) > 3", lambda t: t("lineitem").where(p.and_(p.eq(p.mod(p.floordiv("l_quantity", 7), 2), 1), p.gt(p.mod("l_quantity", 7), 3))).select("l_orderkey", "l_linenumber"))
_add("predicate_notna", f"SELECT event_id FROM {EVENTS} WHERE value IS NOT NULL AND event_type <> 'view'", lambda t: _events(t).where(p.and_(p.notna("value"), p.ne("event_type", "view"))).select("event_id"))
for side, low, high in (("both", ">=", "<="), ("left", ">=", "<"), ("right", ">", "<="), ("neither", ">", "<")):
    _add(f"predicate_between_{side}", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity {low} 10 AND l_quantity {high} 13", lambda t, side=side: t("lineitem").where(p.between("l_quantity", 10, 13, side)).select("l_orderkey", "l_linenumber"))
NAMES = "(SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS p_name FROM part)"
for na in (True, False):
    _add(f"predicate_contains_na_{str(na).lower()}", f"SELECT p_partkey FROM {NAMES} WHERE coalesce(contains(p_name, 'bolt'), {str(na).lower()})", lambda t, na=na: t("part").selectExpr("p_partkey", "IF(p_partkey % 5 = 0, NULL, p_name) AS p_name").where(p.contains("p_name", "bolt", na=na)).select("p_partkey"))
_add("predicate_not_in", f"SELECT p_partkey FROM {NAMES} WHERE p_name IS NULL OR p_name NOT IN ('small ring', 'blue bolt')", lambda t: t("part").selectExpr("p_partkey", "IF(p_partkey % 5 = 0, NULL, p_name) AS p_name").where(p.not_in("p_name", ["small ring", "blue bolt"])).select("p_partkey"))
_add("rank_by_metric", f"SELECT event_id, value FROM {EVENTS} ORDER BY value DESC NULLS LAST, event_id LIMIT 10", lambda t: filters.rank_by_metric(_events(t).select("event_id", "value"), "value", 10, ["event_id"]))

# ---- profiles ----
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_add("profile", " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS nulls, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean, NULL::BIGINT AS n_distinct FROM {EVENTS}" for c, k in (("event_id", "bigint"), ("user_id", "bigint"), ("value", "double"))]
    + [f"SELECT 'event_type', 'string', count(*), count(*) - count(event_type), NULL, NULL, NULL, count(DISTINCT event_type) FROM {EVENTS}"]),
    lambda t: profile.profile(_events(t).select("event_id", "user_id", "value", "event_type")))
_add("profile_columns", f"SELECT 'value' AS \"column\", count(DISTINCT value) AS n_distinct, count(*) - count(value) AS nulls, round(min(value), 2) AS min, round(max(value), 2) AS max FROM {EVENTS} UNION ALL SELECT 'event_type', count(DISTINCT event_type), 0, NULL, NULL FROM events",
     lambda t: profile.profile_columns(_events(t), ["VALUE", "event_type"], stats=True))
_add("first_values", "SELECT event_type AS value, min(event_id) AS first_at FROM events GROUP BY event_type ORDER BY first_at LIMIT 30", lambda t: profile.first_values(t("events"), "event_type", "event_id"))
_add("value_counts", "(SELECT 'p_brand' AS \"column\", p_brand AS value, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 5) UNION ALL (SELECT 'p_size', p_size::VARCHAR, count(*) AS count FROM part GROUP BY p_size ORDER BY count DESC, p_size LIMIT 5)",
     lambda t: profile.value_counts(t("part"), ["p_brand", "p_size"], 5))
_add("check_missing", f"SELECT 'value' AS \"column\", round(100.0 * (count(*) - count(value)) / count(*), 1)::DOUBLE AS missing_pct FROM {EVENTS}", lambda t: profile.check_missing(_events(t)))
_add("describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, .25), 4) AS p25, round(quantile_cont({c}, .5), 4) AS p50, round(quantile_cont({c}, .75), 4) AS p75, round(max({c}), 4) AS max FROM lineitem" for c in NUMBERS), lambda t: profile.describe(t("lineitem"), NUMBERS))
_add("describe_text", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({x}) AS count, count(DISTINCT {x}) AS \"unique\", (SELECT v FROM (SELECT {x} AS v, count(*) AS n FROM {EVENTS} WHERE {x} IS NOT NULL GROUP BY v ORDER BY n DESC, v LIMIT 1)) AS top, (SELECT max(n) FROM (SELECT count(*) AS n FROM {EVENTS} WHERE {x} IS NOT NULL GROUP BY {x})) AS freq FROM {EVENTS}" for c, x in (("event_type", "event_type"), ("first", "CASE WHEN value IS NOT NULL THEN substr(props, 1, 8) END"))),
     lambda t: profile.describe(_events(t).selectExpr("event_type", "IF(value IS NOT NULL, substr(props, 1, 8), NULL) AS first"), ["event_type", "first"]))
_add("value_counts_many", " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS count FROM lineitem GROUP BY {c} ORDER BY count DESC, {c} LIMIT 10)" for c in ("l_linenumber", "l_returnflag", "l_suppkey", "l_partkey")), lambda t: profile.value_counts(t("lineitem"), ["l_linenumber", "l_returnflag", "l_suppkey", "l_partkey"]))
_add("percentiles", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + ", ".join(f"round(quantile_cont({c}, {q / 100}), 4) AS p{q}" for q in (1, 5, 10, 25, 50, 75, 90, 95, 99)) + " FROM lineitem" for c in NUMBERS[:2]), lambda t: profile.percentiles(t("lineitem"), NUMBERS[:2]))
PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
CHARGES = {"l_quantity": "l_quantity", "l_discount": "l_discount", "rebate": "l_quantity * l_discount", "charge": "CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity * l_tax END"}
CHARGE_PAIRS = [(a, b) for i, a in enumerate(CHARGES) for b in list(CHARGES)[i + 1 :]]
_add("correlations", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({CHARGES[a]}, {CHARGES[b]}), 4) AS r FROM lineitem" for a, b in CHARGE_PAIRS) + ") WHERE abs(r) >= 0.5",
     lambda t: profile.correlations(t("lineitem").selectExpr(*[f"{x} AS {n}" for n, x in CHARGES.items()]), 0.5))
_add("correlations_all", " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 4) AS r FROM lineitem" for a, b in PAIRS), lambda t: profile.correlations(t("lineitem").select(*NUMBERS), 0.0))
_add("head", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 7", lambda t: profile.head(t("events").select("event_id", "value"), ["event_id"], 7))
_add("tail", "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 7", lambda t: profile.tail(t("events").select("event_id", "value"), ["event_id"], 7))
_add("sample", None, lambda t: profile.sample(t("events"), 10, seed=1))
_add("sample_facts", "SELECT 10::BIGINT AS n, 10::BIGINT AS n_distinct, 10::BIGINT AS known FROM events LIMIT 1", lambda t: profile.sample(t("events").select("event_id"), 10, seed=1).join(t("events").select("event_id", F.lit(1).alias("one")), "event_id", "left").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_distinct"), F.count("one").alias("known")))
_add("filter_summary", "SELECT count(*) FILTER (l_tax > 0.05) AS count, count(*) AS total, " + ", ".join(f"round({f}({c}) FILTER (l_tax > 0.05), 4)::DOUBLE AS {c}_{n}" for c in ("l_quantity", "l_tax") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + " FROM lineitem",
     lambda t: _rounded(profile.filter_summary(t("lineitem").select("l_quantity", "l_tax"), p.gt("l_tax", 0.05)), *[f"{c}_{n}" for c in ("l_quantity", "l_tax") for n in ("mean", "min", "max")], places=4))
_add("profile_geochem", " UNION ALL ".join(f"SELECT '{e}' AS element, count(*) AS n_intervals, round(sum(l_quantity), 2) AS total_thickness, round(min(l_linenumber), 2)::DOUBLE AS min_from, round(max(l_linenumber + l_quantity), 2) AS max_to, round(sum({e} * l_quantity) / sum(l_quantity), 4) AS weighted_mean, round(max({e}), 4) AS max_value, round(max({e} * l_quantity), 4) AS max_grade_thickness, count(*) - count({e}) AS nulls FROM lineitem" for e in ("l_discount", "l_tax")),
     lambda t: profile.profile_geochem(t("lineitem").selectExpr("l_linenumber AS `from`", "l_linenumber + l_quantity AS `to`", "l_discount", "l_tax"), "from", "to", ["l_discount", "l_tax"]))
_add("profile_geochem_by", "SELECT l_returnflag, 'l_tax' AS element, count(*) AS n_intervals, round(sum(l_quantity), 2) AS total_thickness, round(min(l_linenumber), 2)::DOUBLE AS min_from, round(max(l_linenumber + l_quantity), 2) AS max_to, round(sum(l_tax * l_quantity) / sum(l_quantity), 4) AS weighted_mean, round(max(l_tax), 4) AS max_value, round(max(l_tax * l_quantity), 4) AS max_grade_thickness, 0::BIGINT AS nulls FROM lineitem GROUP BY l_returnflag",
     lambda t: profile.profile_geochem(t("lineitem").selectExpr("l_returnflag", "l_linenumber AS `from`", "l_linenumber + l_quantity AS `to`", "l_tax"), "from", "to", ["l_tax"], by=["l_returnflag"]))

# ---- joins, grouping, reshaping ----
LEFT = "(SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey END AS k, o_totalprice AS v FROM orders)"
RIGHT = "(SELECT c_custkey, CASE WHEN c_custkey % 500 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN -c_custkey ELSE c_custkey END AS k, c_acctbal AS v FROM customer)"


def _merged(t, how: str) -> DataFrame:
    a = t("orders").selectExpr("o_orderkey", "IF(o_custkey % 11 = 0, NULL, o_custkey) AS k", "o_totalprice AS v")
    b = t("customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 500 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN -c_custkey ELSE c_custkey END AS k", "c_acctbal AS v")
    return relational.merge(a, b, ["k"], how).groupBy("k").agg(F.count("*").alias("n"), F.count("o_orderkey").alias("n_left"), F.count("c_custkey").alias("n_right"), F.round(F.sum("v_x"), 2).alias("v_x"), F.round(F.sum("v_y"), 2).alias("v_y"))


for how, word in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _add(f"merge_{how}", f"SELECT k, count(*) AS n, count(o_orderkey) AS n_left, count(c_custkey) AS n_right, round(sum(v_x), 2) AS v_x, round(sum(v_y), 2) AS v_y FROM (SELECT coalesce(a.k, b.k) AS k, o_orderkey, c_custkey, a.v AS v_x, b.v AS v_y FROM {LEFT} a {word} JOIN {RIGHT} b ON a.k IS NOT DISTINCT FROM b.k) GROUP BY k", lambda t, how=how: _merged(t, how))
GRID = {"mean": "avg({c})", "median": "median({c})", "max": "max({c})", "min": "min({c})", "sum": "coalesce(sum({c}), 0)"}
for stat, f in GRID.items():
    _add(f"aggregate_grid_{stat}", f"SELECT round_even(l_extendedprice / 5000, 0) * 5000 AS l_extendedprice_bin, round_even(l_quantity / 5000, 0) * 5000 AS l_quantity_bin, round({f.format(c='l_discount')}, 4) AS l_discount, round({f.format(c='l_tax')}, 4) AS l_tax FROM lineitem GROUP BY 1, 2",
         lambda t, stat=stat: _rounded(relational.aggregate_grid(t("lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax"), 5000, stat, "l_extendedprice", "l_quantity"), "l_discount", "l_tax", places=4))
_add("aggregate_grid", "SELECT round_even(l_discount * 100 / 3, 0) * 3 AS x_bin, round_even(l_quantity / 3, 0) * 3 AS y_bin, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1, 2",
     lambda t: _rounded(relational.aggregate_grid(t("lineitem").selectExpr("l_discount * 100 AS x", "l_quantity AS y", "l_tax"), 3, "mean", "x", "y"), "l_tax"))
_add("aggregate_grid_count", "SELECT round_even(l_discount * 100 / 3, 0) * 3 AS x_bin, round_even(l_quantity / 3, 0) * 3 AS y_bin, count(l_tax) AS count FROM lineitem GROUP BY 1, 2",
     lambda t: relational.aggregate_grid(t("lineitem").selectExpr("l_discount * 100 AS x", "l_quantity AS y", "l_tax"), 3, "count", "x", "y"))
for stat, f in (GRID | {"count": "count({c})"}).items():
    value = "count(p_retailprice) AS count" if stat == "count" else f"round({f.format(c='p_retailprice')}, 4) AS p_retailprice"
    _add(f"aggregate_by_{stat}", f"SELECT p_type, {value} FROM part GROUP BY p_type", lambda t, stat=stat: relational.aggregate_by(t("part").select("p_type", "p_retailprice"), "p_type", stat).withColumns({} if stat == "count" else {"p_retailprice": F.round("p_retailprice", 4)}))
KINDS = ["O", "F", "P"]
_add("pivot", "SELECT o_custkey, " + ", ".join(f"arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = '{k}') AS \"o_totalprice_{k}\"" for k in KINDS) + " FROM orders GROUP BY o_custkey", lambda t: relational.pivot(t("orders"), ["o_custkey"], "o_orderstatus", ["o_totalprice"], KINDS, "first", "o_orderkey"))
_add("pivot_sum", "SELECT o_custkey, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = '{k}'), 0), 2) AS \"o_totalprice_{k}\"" for k in KINDS) + " FROM orders GROUP BY o_custkey", lambda t: _rounded(relational.pivot(t("orders"), ["o_custkey"], "o_orderstatus", ["o_totalprice"], KINDS, "sum"), *[f"o_totalprice_{k}" for k in KINDS], places=2))
_add("pivot_std", "SELECT * FROM (SELECT o_custkey, " + ", ".join(f"round(stddev_samp(o_totalprice) FILTER (o_orderstatus = '{k}'), 4) AS \"o_totalprice_{k}\"" for k in KINDS) + " FROM orders GROUP BY o_custkey) WHERE " + " OR ".join(f'"o_totalprice_{k}" IS NOT NULL' for k in KINDS), lambda t: _rounded(relational.pivot(t("orders"), ["o_custkey"], "o_orderstatus", ["o_totalprice"], None, "std"), *[f"o_totalprice_{k}" for k in KINDS], places=4))
_add("pivot_last", "SELECT o_custkey, " + ", ".join(f"arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = '{k}') AS \"o_totalprice_{k}\"" for k in KINDS) + " FROM orders GROUP BY o_custkey", lambda t: relational.pivot(t("orders"), ["o_custkey"], "o_orderstatus", ["o_totalprice"], None, "last", "o_orderkey"))
_add("melt", " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS variable, {c} AS value FROM lineitem" for c in ("l_discount", "l_tax")), lambda t: relational.melt(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"]))
for which, order in (("first", "ASC"), ("last", "DESC")):
    _add(f"remove_duplicates_{which}", f"SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {order}) AS k FROM events) WHERE k = 1", lambda t, which=which: relational.remove_duplicates(t("events").select("event_id", "user_id", "event_type"), ["event_id"], ["user_id", "event_type"], which))
_add("remove_duplicates_none", "SELECT event_id, user_id, k FROM (SELECT event_id, user_id, floor(value) AS k, count(*) OVER (PARTITION BY user_id, floor(value)) AS n FROM events) WHERE n = 1", lambda t: relational.remove_duplicates(t("events").selectExpr("event_id", "user_id", "CAST(floor(value) AS DOUBLE) AS k"), ["event_id"], ["user_id", "k"], "none"))
_add("duplicate_counts", "SELECT 'l_orderkey,l_linenumber' AS subset, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem UNION ALL SELECT 'l_partkey', count(*) - count(DISTINCT l_partkey) FROM lineitem", lambda t: relational.duplicate_counts(t("lineitem"), [["l_orderkey", "l_linenumber"], ["l_partkey"]]))
for method, w in (("mean", 3), ("mean", 4), ("median", 5)):
    frame = f"ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING"
    agg = "avg" if method == "mean" else "median"
    for part in ("", "user_id"):
        over = f"({'PARTITION BY user_id ' if part else ''}ORDER BY ts, event_id {frame})"
        _add(f"smooth_{method}_{w}" + ("_by_user" if part else ""), f"SELECT event_id, CASE WHEN count(value) OVER {over} = {w} THEN round({agg}(value) OVER {over}, 6) END AS value_smooth FROM {EVENTS}",
             lambda t, method=method, w=w, part=part: _rounded(relational.smooth(_events(t).select("event_id", "user_id", "ts", "value"), "value", w, method, order_by=["ts", "event_id"], partition_by=[part] if part else None, bucket=256), "value_smooth").select("event_id", "value_smooth"))
_add("with_row_id", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events", lambda t: rowid.with_row_id(t("events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "row_id"))

# ---- cleaning ----
LIMIT_SQL = "regexp_matches(trim(Au_ppm), '^([<>≤≥]|<=|>=)\\s*([\\d.]+)$')"
SPECIAL_SQL = "lower(trim(Au_ppm)) IN ('nd', 'bdl', 'na', 'trace', 'nil', '-')"
COMMA_SQL = "length(regexp_extract(trim(Au_ppm), '^\\d+,(\\d+)$', 1))"
PARSED = "CASE WHEN {s} THEN NULL WHEN regexp_matches(trim(Au_ppm), '^(<|≤|<=)\\s*[\\d.]+$') THEN {below} WHEN {l} THEN {x} WHEN regexp_matches(trim(Au_ppm), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN try_cast(trim(Au_ppm) AS DOUBLE) END"
NUMBER_SQL = "try_cast(regexp_extract(trim(Au_ppm), '([\\d.]+)$', 1) AS DOUBLE)"
_add("detection_limit_counts", f"SELECT 'Au_ppm' AS \"column\", count(*) FILTER ({LIMIT_SQL} OR {SPECIAL_SQL}) AS n_limits FROM {ASSAYS} UNION ALL SELECT 'lithology', 0", lambda t: cleaning.detection_limit_counts(_assays(t), ["Au_ppm", "lithology"]))
_add("comma_decimal_counts", f"SELECT 'Au_ppm' AS \"column\", count(*) FILTER ({COMMA_SQL} > 0 AND {COMMA_SQL} <> 3) AS definite, count(*) FILTER ({COMMA_SQL} = 3) AS ambiguous FROM {ASSAYS}", lambda t: cleaning.comma_decimal_counts(_assays(t), ["Au_ppm"]))
_add("fix_decimals", f"SELECT l_orderkey, l_linenumber, CASE WHEN {COMMA_SQL} > 0 AND {COMMA_SQL} <> 3 THEN replace(trim(Au_ppm), ',', '.') ELSE Au_ppm END AS Au_ppm FROM {ASSAYS}", lambda t: cleaning.fix_decimals(_assays(t).select("l_orderkey", "l_linenumber", "Au_ppm"), ["Au_ppm"]))
_add("fix_decimals_found", f"SELECT l_orderkey, l_linenumber, CASE WHEN {COMMA_SQL} > 0 AND {COMMA_SQL} <> 3 THEN replace(trim(Au_ppm), ',', '.') ELSE Au_ppm END AS Au_ppm, lithology FROM {ASSAYS}", lambda t: cleaning.fix_decimals(_assays(t).select("l_orderkey", "l_linenumber", "Au_ppm", "lithology")))
for method, below in (("half", f"{NUMBER_SQL} / 2"), ("zero", "0.0"), ("value", NUMBER_SQL)):
    _add(f"parse_detection_limits_{method}", f"SELECT l_orderkey, l_linenumber, {PARSED.format(s=SPECIAL_SQL, l=LIMIT_SQL, x=NUMBER_SQL, below=below)} AS Au_ppm FROM {ASSAYS}", lambda t, method=method: cleaning.parse_detection_limits(_assays(t).select("l_orderkey", "l_linenumber", "Au_ppm"), ["Au_ppm"], method))
_add("limit_report", f"SELECT 'Au_ppm' AS \"column\", count(*) FILTER (regexp_matches(trim(Au_ppm), '^(<|≤|<=)\\s*[\\d.]+$')) AS below, count(*) FILTER (regexp_matches(trim(Au_ppm), '^(>|≥|>=)\\s*[\\d.]+$')) AS above, count(*) FILTER ({SPECIAL_SQL}) AS special, count(*) FILTER (NOT {SPECIAL_SQL} AND {PARSED.format(s='false', l=LIMIT_SQL, x=NUMBER_SQL, below=NUMBER_SQL)} IS NULL) AS parse_error FROM {ASSAYS}", lambda t: cleaning.limit_report(_assays(t), ["Au_ppm"]))
_add("standardize_terms", f"SELECT l_orderkey, l_linenumber, regexp_replace(trim(lithology), '\\s+', ' ', 'g') AS lithology FROM {ASSAYS}", lambda t: cleaning.standardize_terms(_assays(t).select("l_orderkey", "l_linenumber", "lithology"), ["lithology"]))
_add("standardize_terms_mapped", f"SELECT l_orderkey, l_linenumber, CASE lower(trim(lithology)) WHEN 'a' THEN 'granite' WHEN 'n' THEN 'basalt' ELSE trim(lithology) END AS lithology FROM {ASSAYS}", lambda t: cleaning.standardize_terms(_assays(t).select("l_orderkey", "l_linenumber", "lithology"), ["lithology"], {" A ": "granite", "n": "basalt"}))
_add("term_report", f"SELECT 'lithology' AS \"column\", count(*) FILTER (lithology <> regexp_replace(trim(lithology), '\\s+', ' ', 'g')) AS changed, count(DISTINCT lithology) AS distinct_before, count(DISTINCT regexp_replace(trim(lithology), '\\s+', ' ', 'g')) AS distinct_after FROM {ASSAYS}", lambda t: cleaning.term_report(_assays(t), ["lithology"]))


def _survey(t) -> DataFrame:
    return _assays(t).selectExpr("l_orderkey AS hole_id", "l_linenumber AS depth", "Au_ppm", "l_tax - 0.02 AS Cu_pct", "lithology", "l_quantity AS easting")


SURVEY = f"(SELECT l_orderkey AS hole_id, l_linenumber AS depth, Au_ppm, l_tax - 0.02 AS Cu_pct, lithology, l_quantity AS easting FROM {ASSAYS})"
_add("validate_geology", f"""SELECT * FROM (SELECT 'missing_column' AS "check", 'lat' AS "column", 1::BIGINT AS n
UNION ALL SELECT 'detection_limits', 'Au_ppm', count(*) FILTER ({LIMIT_SQL} OR {SPECIAL_SQL}) FROM {SURVEY}
UNION ALL SELECT 'comma_decimals', 'Au_ppm', count(*) FILTER ({COMMA_SQL} > 0 AND {COMMA_SQL} <> 3) FROM {SURVEY}
UNION ALL SELECT 'ambiguous_commas', 'Au_ppm', count(*) FILTER ({COMMA_SQL} = 3) FROM {SURVEY}
UNION ALL SELECT 'negative_values', 'Cu_pct', count(*) FILTER (Cu_pct < 0) FROM {SURVEY}
UNION ALL SELECT 'duplicate_rows', '*', count(*) - count(DISTINCT (hole_id, depth, Au_ppm, Cu_pct, lithology, easting)) FROM {SURVEY}
UNION ALL SELECT 'duplicate_intervals', 'hole_id,depth', count(*) - count(DISTINCT (hole_id, depth)) FROM {SURVEY}) WHERE n > 0""", lambda t: cleaning.validate_geology(_survey(t)))
UNPARSED = f"NOT ({LIMIT_SQL} OR {SPECIAL_SQL}) AND NOT regexp_matches(replace(trim(Au_ppm), ',', '.'), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')"
_add("detect_cleaning_issues", f"""SELECT 'Au_ppm' AS "column", 'string' AS dtype, 'geochem' AS kind, 0::BIGINT AS nulls, count(DISTINCT Au_ppm) AS n_distinct, count(*) FILTER ({LIMIT_SQL} OR {SPECIAL_SQL}) AS n_limits, count(*) FILTER ({COMMA_SQL} > 0 AND {COMMA_SQL} <> 3) AS n_commas, count(*) FILTER ({COMMA_SQL} = 3) AS n_ambiguous, count(*) FILTER ({UNPARSED}) AS n_unparsed, NULL::BIGINT AS n_outliers, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::BIGINT AS n_negative FROM {SURVEY}
UNION ALL SELECT 'Cu_pct', 'double', 'geochem', 0, NULL, NULL, NULL, NULL, NULL, count(*) FILTER (Cu_pct < a - 1.5 * (b - a) OR Cu_pct > b + 1.5 * (b - a)), min(Cu_pct), max(Cu_pct), count(*) FILTER (Cu_pct < 0) FROM {SURVEY}, (SELECT quantile_cont(Cu_pct, .25) AS a, quantile_cont(Cu_pct, .75) AS b FROM {SURVEY})""", lambda t: cleaning.detect_cleaning_issues(_survey(t).select("Au_ppm", "Cu_pct")))

# ---- anomaly, clustering ----
_add("anomaly_zscore", f"SELECT event_id, round((value - m) / s, 6) AS value_anom_z FROM {EVENTS}, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM {EVENTS})", lambda t: _rounded(an.anomaly(_events(t).select("event_id", "value"), ["value"], "zscore"), "value_anom_z").drop("value"))
_add("anomaly_mad", f"SELECT event_id, round(0.6745 * (value - m) / s, 6) AS value_anom_mad FROM {EVENTS}, (SELECT median(value) AS m, mad(value) AS s FROM {EVENTS})", lambda t: _rounded(an.anomaly(_events(t).select("event_id", "value"), ["value"], "mad"), "value_anom_mad").drop("value"))
_add("anomaly_ratio", f"SELECT event_id, round(value / m, 6) AS value_anom_ratio FROM {EVENTS}, (SELECT avg(value) AS m FROM {EVENTS})", lambda t: _rounded(an.anomaly(_events(t).select("event_id", "value"), ["value"], "ratio"), "value_anom_ratio").drop("value"))


def _features(t, n: int) -> DataFrame:
    return t("embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])


EPS = 9.0
#: Standardized vectors z of all embeddings.
STANDARD = """(SELECT vec_id, list(z ORDER BY pos) AS z FROM (SELECT vec_id, pos, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM
(SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings) WINDOW w AS (PARTITION BY pos)) GROUP BY vec_id)"""


def _vectors(t) -> DataFrame:
    return t("embeddings").select("vec_id", "embedding")


def _clusters(t) -> DataFrame:
    return ml.kmeans(_vectors(t), "embedding", 10).select("vec_id", "cluster_kmeans")


def _kmeans_facts(t) -> DataFrame:
    """What must hold of any k-means result: every row has a label, labels are in range, and the rows lie closer to their
    clusters' means than to the common mean."""
    labels = _clusters(t)
    z = ml.standardized(_vectors(t), "embedding").select("vec_id", F.posexplode("_z").alias("at", "z"))
    parts = z.join(labels, "vec_id").groupBy("cluster_kmeans", "at").agg((F.sum(F.col("z") * F.col("z"))).alias("square"), (F.count("*") * F.avg("z") * F.avg("z")).alias("between"))
    closer = parts.agg((F.sum("between") > 0.02 * F.sum("square")).alias("closer"))
    return labels.agg(F.count("*").alias("n"), F.count_if(F.col("cluster_kmeans").between(0, 9)).alias("labelled"), F.count_distinct("cluster_kmeans").alias("k")).crossJoin(closer)


def _kmeans_fixed_point(t) -> DataFrame:
    """For every row: whether the mean of its label's rows is the nearest of all such means. Where this holds of all rows,
    labels and means are a fixed point of k-means."""
    z = ml.standardized(_vectors(t), "embedding").select("vec_id", "_z")
    rows = keep(z.join(_clusters(t), "vec_id"))
    means = rows.select("cluster_kmeans", F.posexplode("_z").alias("at", "x")).groupBy("cluster_kmeans", "at").agg(F.avg("x").alias("m"))
    means = means.groupBy("cluster_kmeans").agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("c")).select(F.col("cluster_kmeans").alias("k"), F.col("c.m").alias("m"))
    d2 = F.aggregate(F.zip_with("_z", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    near = rows.crossJoin(F.broadcast(means)).groupBy("vec_id", "cluster_kmeans").agg(F.min(d2).alias("least"), F.min(F.when(F.col("k") == F.col("cluster_kmeans"), d2)).alias("own"))
    return near.select("vec_id", (F.col("own") <= F.col("least") + 1e-9).alias("nearest"))


def _pca_facts(t) -> DataFrame:
    """Components are centred and uncorrelated, the first has the larger variance, and neither more than the whole."""
    rows, share = ml.pca(_vectors(t), "embedding", 2)
    centred = (F.abs(F.avg("PCA1")) < 1e-6) & (F.abs(F.avg("PCA2")) < 1e-6)
    own = F.abs(F.var_samp("PCA1") / 64 - share[0]) < 0.01 * share[0] + 0.001
    return rows.agg(F.count("PCA1").alias("n"), centred.alias("centred"), (F.abs(F.corr("PCA1", "PCA2")) < 1e-6).alias("uncorrelated"), (F.var_samp("PCA1") >= F.var_samp("PCA2")).alias("ordered"), own.alias("share_fits"))


def _power(name: str, start: str, squarings: int = 15) -> str:
    """SQL tables of the leading eigenvector ({name}_v: i, x; the largest entry positive) and eigenvalue ({name}_l) of the
    matrix in {start} (i, j, x), by squaring it again and again."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT i, j, x / (SELECT max(abs(x)) FROM {start}) AS x FROM {start})"]
    for k in range(squarings):
        steps.append(f"{name}{k + 1}s AS MATERIALIZED (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM {name}{k} a JOIN {name}{k} b ON a.j = b.i GROUP BY ALL)")
        steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT i, j, x / (SELECT max(abs(x)) FROM {name}{k + 1}s) AS x FROM {name}{k + 1}s)")
    last = f"{name}{squarings}"
    steps.append(f"{name}_c AS MATERIALIZED (SELECT i, x FROM {last} WHERE j = (SELECT arg_max(i, x) FROM {last} WHERE i = j))")
    steps.append(f"{name}_v AS MATERIALIZED (SELECT i, x * sign((SELECT arg_max(x, abs(x)) FROM {name}_c)) / sqrt((SELECT sum(x * x) FROM {name}_c)) AS x FROM {name}_c)")
    steps.append(f"{name}_l AS MATERIALIZED (SELECT sum(a.x * m.x * b.x) AS l FROM {start} m JOIN {name}_v a ON a.i = m.i JOIN {name}_v b ON b.i = m.j)")
    return ", ".join(steps)


_add("kmeans", None, _clusters)
_add("kmeans_facts", "SELECT count(*) AS n, count(*) AS labelled, 10::BIGINT AS k, true AS closer FROM embeddings", _kmeans_facts)
_add("kmeans_fixed_point", "SELECT vec_id, true AS nearest FROM embeddings", _kmeans_fixed_point)
_add("pca", f"""WITH s AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, unnest(z) AS z FROM {STANDARD}),
m AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.z * b.z) / ((SELECT count(*) FROM embeddings) - 1) AS x FROM s a JOIN s b ON a.vec_id = b.vec_id GROUP BY ALL), {_power('p', 'm')},
d AS MATERIALIZED (SELECT m.i, m.j, m.x - l * a.x * b.x AS x FROM m JOIN p_v a ON a.i = m.i JOIN p_v b ON b.i = m.j, p_l), {_power('q', 'd')}
SELECT vec_id, round(sum(z * p_v.x), 4) AS PCA1, round(sum(z * q_v.x), 4) AS PCA2 FROM s JOIN p_v ON p_v.i = s.i JOIN q_v ON q_v.i = s.i GROUP BY vec_id""",
     lambda t: _rounded(ml.pca(_vectors(t), "embedding", 2)[0].select("vec_id", "PCA1", "PCA2"), "PCA1", "PCA2", places=4))
_add("pca_facts", "SELECT count(*) AS n, true AS centred, true AS uncorrelated, true AS ordered, true AS share_fits FROM embeddings", _pca_facts)


def _dbscan_sql(standard: str, eps: float, least: int) -> str:
    return f"""WITH RECURSIVE v AS MATERIALIZED {standard}, near AS MATERIALIZED (SELECT a.vec_id AS id, b.vec_id AS other FROM v a JOIN v b ON list_distance(a.z, b.z) <= {eps}),
core AS MATERIALIZED (SELECT id FROM near GROUP BY id HAVING count(*) >= {least}),
link AS MATERIALIZED (SELECT id, other FROM near WHERE id IN (SELECT id FROM core) AND other IN (SELECT id FROM core)),
reach AS (SELECT id, id AS root FROM core UNION SELECT link.other, reach.root FROM reach JOIN link ON link.id = reach.id WHERE reach.root < link.other),
named AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
number AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS k FROM named),
border AS (SELECT near.id, min(k) AS k FROM near JOIN number ON number.id = near.other GROUP BY near.id)
SELECT vec_id, coalesce(number.k, border.k, -1)::INT AS cluster_dbscan FROM v LEFT JOIN number ON number.id = vec_id LEFT JOIN border ON border.id = vec_id"""


#: Eps and least rows of the clusters of the first three values: several clusters, borders and noise.
NEAR, LEAST = 0.3, 5
STANDARD_3 = STANDARD.replace("unnest(embedding)", "unnest(embedding[1:3])").replace("range(64)", "range(3)")
_add("dbscan", _dbscan_sql(STANDARD, EPS, 5), lambda t: ml.dbscan(_vectors(t), "embedding", "vec_id", EPS, 5))
_add("dbscan_three", _dbscan_sql(STANDARD_3, NEAR, LEAST), lambda t: ml.dbscan(_features(t, 3), ["e0", "e1", "e2"], "vec_id", NEAR, LEAST))

# ---- verification and grading ----
CLAIMS = [(1, 25.5, "l_quantity", "mean", None, None), (2, 50.0, "l_quantity", "max", None, None), (3, 3.0, "l_quantity", "min", None, None), (4, 0.0, "l_tax", "min", None, None), (5, 0.05, "l_discount", "median", None, 0.2), (6, 0.03, "l_discount", "std", None, 0.1), (7, 1.0, "nothing", "mean", None, None), (8, 1.0, "l_tax", "mode", None, None), (9, None, "l_tax", "mean", None, None), (10, 17.0, "l_quantity", "exact", None, None), (11, 1.0, "l_tax", "sum", None, None)]
CLAIM = "claim_id bigint, value double, column string, operation string, rows array<bigint>, tolerance double"
STAT_SQL = {"mean": "avg", "max": "max", "min": "min", "median": "median", "std": "stddev_samp", "sum": "sum"}


def _claims(df: DataFrame, rows: list) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, CLAIM)


def _claim_sql(i, value, column, op, tol) -> str:
    bad = "missing field" if value is None else "unknown column" if column == "nothing" else "unknown operation" if op == "mode" else None
    if bad:
        return f"SELECT {i}::BIGINT AS claim_id, 'not_found' AS status, '{bad}' AS reason, NULL::DOUBLE AS actual, NULL::DOUBLE AS relative_error"
    a = f"(SELECT {column} FROM lineitem ORDER BY abs({column} - {value}) LIMIT 1)" if op == "exact" else f"(SELECT {STAT_SQL[op]}({column}) FROM lineitem)"
    err = f"abs({a})" if value == 0 else f"abs({a} - {value}) / {abs(value)}"
    return f"SELECT {i}::BIGINT AS claim_id, CASE WHEN {err} <= {tol or 0.01} THEN 'verified' ELSE 'failed' END AS status, NULL AS reason, round({a}, 6)::DOUBLE AS actual, round({err}, 4)::DOUBLE AS relative_error"


_add("verify_claims", " UNION ALL ".join(_claim_sql(i, v, c, o, tol) for i, v, c, o, _, tol in CLAIMS), lambda t: verify.verify_claims(t("lineitem"), _claims(t("lineitem"), CLAIMS)))
_add("verify_claims_ranges", """SELECT 1::BIGINT AS claim_id, CASE WHEN abs(a - 50) / 50 <= 0.5 THEN 'verified' ELSE 'failed' END AS status, NULL AS reason, round(a, 6) AS actual, round(abs(a - 50) / 50, 4) AS relative_error FROM (SELECT avg(value) AS a FROM events WHERE event_id BETWEEN 100 AND 299)
UNION ALL SELECT 2, 'verified', NULL, 200.0, 0.0 UNION ALL SELECT 3, 'not_found', 'range out of bounds', NULL, NULL""",
     lambda t: verify.verify_claims(t("events"), _claims(t("events"), [(1, 50.0, "value", "mean", [100, 299], 0.5), (2, 200.0, "value", "count", [100, 299], None), (3, 1.0, "value", "max", [5, 10**9], None)]), row_id="event_id"))
_add("verify_claims_text", "SELECT 1::BIGINT AS claim_id, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#1') THEN 'verified' ELSE 'not_found' END AS status UNION ALL SELECT 2, 'not_found' UNION ALL SELECT 3, 'verified'",
     lambda t: verify.verify_claims(t("part").select("p_brand", "p_type", "p_size"), t("part").sparkSession.createDataFrame([(1, None, "p_brand", "exact", None, None, "Brand#1"), (2, None, "p_type", "exact", None, None, "no such type"), (3, 1.0, "p_size", "min", None, 0.01, None)], CLAIM + ", text string")).select("claim_id", "status"))
_add("verify_members", "SELECT 1::BIGINT AS claim_id, EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#1') AS found UNION ALL SELECT 2, EXISTS (SELECT 1 FROM part WHERE p_type = 'no such type')",
     lambda t: verify.verify_members(t("part").select("p_brand", "p_type"), t("part").sparkSession.createDataFrame([(1, "p_brand", "Brand#1"), (2, "p_type", "no such type")], "claim_id bigint, column string, value string")))


def _hypotheses(t) -> DataFrame:
    """One prediction for each part type and customer segment, with ranges taken from the table."""
    return t("part").groupBy("p_type").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.count("*").alias("n")).selectExpr(
        "concat('size of ', p_type) AS text", "'existence' AS claim_type", "'p_size' AS column_a", "CAST(NULL AS STRING) AS column_b", "IF(n % 2 = 0, 'positive', 'none') AS direction", "array(0.1D, 0.3D + n % 3) AS magnitude_range",
        "array(CAST(lo AS DOUBLE), CAST(hi AS DOUBLE)) AS value_range", "n AS expected_count", "array(n - 1, n + 1) AS count_range", "CAST(NULL AS BIGINT) AS cluster_id", "CAST(hi - 1 AS DOUBLE) AS threshold", "IF(n % 2 = 0, 'a reason of some length here', NULL) AS reasoning")


H_SQL = "(SELECT 'size of ' || p_type AS text, min(p_size) AS lo, max(p_size) AS hi, count(*) AS n FROM part GROUP BY p_type)"
_add("specificity_score", f"SELECT text, 2 + CASE WHEN 0.2 + n % 3 < 0.3 THEN 1 ELSE 0 END + CASE WHEN lo <> 0 AND (hi - lo) / abs(lo)::DOUBLE < 0.5 THEN 1 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS score FROM {H_SQL}", lambda t: _hypotheses(t).select("text", hypotheses.specificity_score().alias("score")))
_add("grade_existence", f"SELECT text, (SELECT count(*) FROM part WHERE p_size > h.hi - 1)::DOUBLE AS actual_value, (SELECT count(*) FROM part WHERE p_size > h.hi - 1) > 0 AS is_correct FROM {H_SQL} h", lambda t: hypotheses.grade_existence(_hypotheses(t), t("part"), ["p_size"]).select("text", "actual_value", "is_correct"))
_add("grade_distribution", f"SELECT text, round((SELECT avg(p_size) FROM part), 4) AS actual_value, (SELECT round(avg(p_size), 4) FROM part) BETWEEN lo AND hi AS is_correct FROM {H_SQL}", lambda t: hypotheses.grade_distribution(_hypotheses(t), profile.profile(t("part").select("p_size"))).select("text", "actual_value", "is_correct"))
_add("grade_correlation", f"SELECT text, r AS actual_value, CASE WHEN n % 2 = 0 THEN r > 0 ELSE abs(r) <= 0.1 END AND r BETWEEN 0.1 AND 0.3 + n % 3 AS is_correct FROM {H_SQL}, (SELECT round(corr(p_size, p_retailprice), 4) AS r FROM part)",
     lambda t: hypotheses.grade_correlation(_hypotheses(t).withColumn("column_b", F.lit("p_retailprice")), profile.correlations(t("part").select("p_size", "p_retailprice"), 0.0)).select("text", "actual_value", "is_correct"))
_add("grade_cluster", f"SELECT text, (SELECT count(DISTINCT p_brand) FROM part)::DOUBLE AS actual_value, (SELECT count(DISTINCT p_brand) FROM part) BETWEEN n - 1 AND n + 1 AS is_correct FROM {H_SQL}", lambda t: hypotheses.grade_cluster(_hypotheses(t), ml.cluster_sizes(t("part"), "p_brand")).select("text", "actual_value", "is_correct"))
_add("grade_anomaly", f"SELECT text, a::DOUBLE AS actual_value, a BETWEEN n - 1 AND n + 1 AS is_correct FROM {H_SQL}, (SELECT count(*) FILTER (p_size > 45) AS a FROM part)",
     lambda t: hypotheses.grade_anomaly(_hypotheses(t), t("part").agg(F.count_if(F.col("p_size") > 45).alias("n")).select(F.lit("p_size").alias("column"), "n")).select("text", "actual_value", "is_correct"))
_add("grade_count", f"SELECT text, (SELECT count(*) FROM part WHERE p_size > 25)::DOUBLE AS actual_value, (SELECT count(*) FROM part WHERE p_size > 25) BETWEEN n - 1 AND n + 1 AS is_correct FROM {H_SQL}", lambda t: hypotheses.grade_count(_hypotheses(t), {"matching_rows": filters.threshold(t("part"), "p_size", 25).count()}).select("text", "actual_value", "is_correct"))
TYPES = ["correlation", "distribution", "cluster", "anomaly", "existence", "count", "comparison", "trend", "general"]


def _mixed(t) -> DataFrame:
    """A prediction of every type in turn for each part and what it says of itself."""
    kind = f"element_at(array({', '.join(repr(k) for k in TYPES)}), CAST(p_partkey % 9 AS INT) + 1)"
    return t("part").selectExpr(
        "concat('part ', p_partkey) AS text", f"{kind} AS claim_type", "IF(p_partkey % 4 = 3, 'nothing', 'p_size') AS column_a", "IF(p_partkey % 9 = 0, 'p_retailprice', NULL) AS column_b",
        "CASE p_partkey % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'none' END AS direction", "IF(p_partkey % 2 = 0, array(-0.5D, 0.5D), NULL) AS magnitude_range",
        "IF(p_partkey % 6 < 4, array(CAST(p_size AS DOUBLE), p_size + 30.0D), NULL) AS value_range", "IF(p_partkey % 5 = 1, p_size, NULL) AS expected_count", "IF(p_partkey % 5 = 0, array(p_size - 5L, p_size + 5L), NULL) AS count_range",
        "IF(p_partkey % 9 = 2, p_size % 12, NULL) AS cluster_id", "IF(p_partkey % 8 < 6, CAST(p_size AS DOUBLE), NULL) AS threshold", "CAST(NULL AS STRING) AS reasoning")


def _evaluated(t) -> DataFrame:
    part = t("part")
    out = hypotheses.evaluate(
        _mixed(t), pairs=profile.correlations(part.select("p_size", "p_retailprice"), 0.0), stats=profile.profile(part.select("p_size")), clusters=part.groupBy((F.col("p_size") % 10).alias("cluster")).agg(F.count("*").alias("size")),
        anomalies=part.agg(F.count_if(F.col("p_size") > 45).alias("n")).select(F.lit("p_size").alias("column"), "n"), rows=part, columns=["p_size"], result={"n": 27})
    return out.select("text", "claim_type", "actual_value", "is_correct")


_KIND = "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(TYPES)) + " END"
_add("evaluate", f"""WITH g AS (SELECT round(corr(p_size, p_retailprice), 4) AS r, round(avg(p_size), 4) AS m, count(DISTINCT p_size % 10) AS k, count(*) FILTER (p_size > 45) AS a FROM part),
c AS (SELECT p_size % 10 AS cluster, count(*) AS size FROM part GROUP BY 1), s AS (SELECT x.t, count(*) FILTER (p_size > x.t) AS n FROM (SELECT DISTINCT p_size AS t FROM part) x, part GROUP BY x.t),
h AS (SELECT 'part ' || p_partkey AS text, {_KIND} AS claim_type, p_partkey AS key, p_size AS z, p_partkey % 4 <> 3 AS known, c.size AS size FROM part LEFT JOIN c ON p_partkey % 9 = 2 AND c.cluster = p_size % 12),
v AS (SELECT h.*, CASE WHEN claim_type = 'count' THEN 27 WHEN claim_type = 'cluster' THEN CASE WHEN key % 5 < 2 THEN k ELSE size END WHEN NOT known THEN NULL WHEN claim_type = 'correlation' THEN r
    WHEN claim_type = 'distribution' THEN m WHEN claim_type = 'anomaly' THEN a WHEN claim_type = 'existence' AND key % 8 < 6 THEN n END::DOUBLE AS v FROM h JOIN g ON true LEFT JOIN s ON s.t = z),
w AS (SELECT *, CASE key % 5 WHEN 0 THEN v BETWEEN z - 5 AND z + 5 WHEN 1 THEN v = z END AS counted FROM v)
SELECT text, claim_type, v AS actual_value, CASE claim_type WHEN 'correlation' THEN CASE key % 5 WHEN 0 THEN v > 0 WHEN 1 THEN v < 0 WHEN 2 THEN abs(v) <= 0.1 ELSE v IS NOT NULL OR NULL END AND (key % 2 = 1 OR v BETWEEN -0.5 AND 0.5)
    WHEN 'distribution' THEN CASE WHEN key % 6 < 4 THEN v BETWEEN z AND z + 30 END WHEN 'cluster' THEN CASE WHEN key % 5 < 2 THEN counted WHEN size IS NULL THEN false WHEN key % 6 < 4 THEN size BETWEEN z AND z + 30 END
    WHEN 'anomaly' THEN CASE key % 5 WHEN 1 THEN abs(v - z) <= greatest(1, 0.1 * z) ELSE counted END WHEN 'existence' THEN v > 0 WHEN 'count' THEN counted END AS is_correct FROM w""", _evaluated)
_add("to_samples", f"SELECT verdict, count(*) AS n, round(avg(score), 4) AS mean_score FROM (SELECT CASE WHEN (SELECT avg(p_size) FROM part) BETWEEN lo AND hi THEN 'correct' ELSE 'rejected' END AS verdict, 2 + CASE WHEN 0.2 + n % 3 < 0.3 THEN 1 ELSE 0 END + CASE WHEN lo <> 0 AND (hi - lo) / abs(lo)::DOUBLE < 0.5 THEN 1 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS score FROM {H_SQL}) GROUP BY verdict",
     lambda t: hypotheses.sample_report(hypotheses.to_samples(hypotheses.grade_distribution(_hypotheses(t), profile.profile(t("part").select("p_size"))), "q", "c")))
_add("parse_hypotheses", "SELECT p_partkey AS response_id, 0 AS nth, p_name AS text, 'count' AS claim_type FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 1, p_brand, 'general' FROM part WHERE p_partkey % 2 = 1",
     lambda t: hypotheses.parse_hypotheses(t("part").selectExpr("p_partkey AS response_id", """IF(p_partkey % 2 = 0, concat('Here: [{"text": "', p_name, '", "claim_type": "count"}] end'), concat('Predictions\n1. ', p_brand, '\n- no item'))  AS response""")).select("response_id", "nth", "text", "claim_type"))

# ---- plot data ----
_add("histogram", "WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem), c AS (SELECT least(floor((l_extendedprice - lo) / w), 29)::INT AS bin, count(*) AS n FROM lineitem, s GROUP BY 1), g AS (SELECT unnest(range(30))::INT AS bin) SELECT g.bin, round(lo + g.bin * w, 4) AS low, round(lo + (g.bin + 1) * w, 4) AS high, coalesce(n, 0) AS n FROM g CROSS JOIN s LEFT JOIN c ON c.bin = g.bin", lambda t: _rounded(plotdata.histogram(t("lineitem"), "l_extendedprice"), "low", "high", places=4))
_add("density", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n, stddev_samp(l_extendedprice) * pow(count(*), -0.2) AS h FROM lineitem),
b AS (SELECT lo + (bin + 0.5) * (hi - lo) / 2000 AS m, k FROM (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 2000)), 1999) AS bin, count(*) AS k FROM lineitem, s GROUP BY 1), s)
SELECT round(lo + (hi - lo) * i / 199, 3) AS x, round(1e6 * sum(k * exp(-0.5 * pow((lo + (hi - lo) * i / 199 - m) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 4) AS density FROM b, s, (SELECT unnest(range(200)) AS i) GROUP BY i, lo, hi""", lambda t: plotdata.density(t("lineitem"), "l_extendedprice").select(F.round("x", 3).alias("x"), F.round(F.col("density") * 1e6, 4).alias("density")))
_add("scatter_bins", "SELECT least(floor((l_extendedprice - x0) / (x1 - x0) * 20), 19)::INT AS x_bin, least(floor((l_quantity - y0) / (y1 - y0) * 20), 19)::INT AS y_bin, count(*) AS n, round(avg(l_tax), 6) AS colour FROM lineitem, (SELECT min(l_extendedprice) AS x0, max(l_extendedprice) AS x1, min(l_quantity) AS y0, max(l_quantity) AS y1 FROM lineitem) GROUP BY 1, 2", lambda t: _rounded(plotdata.scatter_bins(t("lineitem"), "l_extendedprice", "l_quantity", 20, "l_tax"), "colour"))
_add("map_bins", "SELECT round_even(l_extendedprice / 4000, 0) * 4000 AS x, round_even(l_quantity / 4000, 0) * 4000 AS y, count(*) AS n, round(avg(l_tax), 6) AS value FROM lineitem GROUP BY 1, 2", lambda t: _rounded(plotdata.map_bins(t("lineitem"), "l_extendedprice", "l_quantity", 4000, "l_tax"), "value"))
_add("cluster_summary", "SELECT label AS cluster, count(*) AS n, round(avg(embedding[1]), 4) AS mean_x, round(min(embedding[1]), 4) AS min_x, round(max(embedding[1]), 4) AS max_x, round(avg(embedding[2]), 4) AS mean_y, round(min(embedding[2]), 4) AS min_y, round(max(embedding[2]), 4) AS max_y FROM (SELECT label, embedding::DOUBLE[] AS embedding FROM embeddings) GROUP BY label", lambda t: _rounded(plotdata.cluster_summary(_features(t, 2), "e0", "e1", "label"), "mean_x", "min_x", "max_x", "mean_y", "min_y", "max_y", places=4))

_add("cluster_bins", "SELECT label AS cluster, CASE WHEN x1 = x0 THEN 0 ELSE least(floor((x - x0) / (x1 - x0) * 8), 7) END::INT AS x_bin, CASE WHEN y1 = y0 THEN 0 ELSE least(floor((y - y0) / (y1 - y0) * 8), 7) END::INT AS y_bin, count(*) AS n FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), (SELECT min(embedding[1]::DOUBLE) AS x0, max(embedding[1]::DOUBLE) AS x1, min(embedding[2]::DOUBLE) AS y0, max(embedding[2]::DOUBLE) AS y1 FROM embeddings) GROUP BY 1, 2, 3", lambda t: plotdata.cluster_bins(_features(t, 2), "e0", "e1", "label", 8))

# ---- rasters: cells of a 100-column grid that follow the lineitem table ----
WIDTH = 100


def _cells(t) -> tuple[DataFrame, DataFrame]:
    """Every part is a cell: its key gives row and column, price and size the bands."""
    cells = t("part").selectExpr("'r' AS raster_id", f"CAST(p_partkey DIV {WIDTH} AS INT) AS row", f"CAST(p_partkey % {WIDTH} AS INT) AS col", "p_retailprice AS b1", "CAST(p_size AS DOUBLE) AS b2")
    cells = cells.select("raster_id", "row", "col", (500005 + F.col("col") * 10.0).alias("x"), (5999995 - F.col("row") * 10.0).alias("y"), "b1", "b2")
    meta = cells.groupBy("raster_id").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"))
    fixed = {"bands": F.lit(2), "crs": F.lit("EPSG:32750")} | {k: F.lit(v) for k, v in zip("abcdef", (10.0, 0.0, 500000.0, 0.0, -10.0, 6000000.0))} | {"nodata": F.lit(None).cast("double")}
    return cells, meta.withColumns(fixed)


CELLS = f"(SELECT 'r' AS raster_id, (p_partkey // {WIDTH})::INT AS row, (p_partkey % {WIDTH})::INT AS col, 500005 + (p_partkey % {WIDTH}) * 10.0::DOUBLE AS x, 5999995 - (p_partkey // {WIDTH}) * 10.0::DOUBLE AS y, p_retailprice AS b1, p_size::DOUBLE AS b2 FROM part)"
_add("raster_info", f"SELECT 'r' AS raster_id, max(col) + 1 AS width, max(row) + 1 AS height, 2 AS bands, 'EPSG:32750' AS crs, round(min(b1), 2) AS min, round(max(b1), 2) AS max, round(avg(b1), 2) AS mean, round(stddev_pop(b1), 2) AS std FROM {CELLS}", lambda t: _rounded(raster.raster_info(*_cells(t), verbose=True), "min", "max", places=2).select("raster_id", "width", "height", "bands", "crs", "min", "max", "mean", "std"))
_add("select_bands", f"SELECT raster_id, row, col, x, y, b2 AS b1 FROM {CELLS}", lambda t: raster.select_bands(_cells(t)[0], [2]))
_add("band_math", f"SELECT row, col, round(CASE WHEN b2 > 10 THEN (b1 - b2) / (b1 + b2) ELSE sqrt(b2) END, 3) AS b1 FROM {CELLS}", lambda t: raster.band_math(_cells(t)[0], "IF(b2 > 10, try_divide(b1 - b2, b1 + b2), sqrt(b2))").select("row", "col", F.round(F.col("b1").cast("double"), 3).alias("b1")))
_add("clip_to_extent", f"SELECT (row - 2)::INT AS row, (col - 10)::INT AS col, x, y, b1 FROM {CELLS} WHERE x BETWEEN 500100 AND 500300 AND y BETWEEN 5999900 AND 5999980", lambda t: raster.clip_to_extent(*_cells(t), (500100, 5999900, 500300, 5999980)).select("row", "col", "x", "y", "b1"))
_add("sobel_gradient", f"""WITH c AS {CELLS}, s AS (SELECT max(row) AS h, max(col) AS w FROM c), k AS (SELECT i, j, CASE j WHEN 0 THEN 0.5 ELSE 0.25 END * -i AS gy, CASE i WHEN 0 THEN 0.5 ELSE 0.25 END * -j AS gx FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
n AS (SELECT c.row, c.col, sum(gx * v.b1) AS gx, sum(gy * v.b1) AS gy FROM c, s, k JOIN c v ON v.row = greatest(0, least(h, c.row + i)) AND v.col = greatest(0, least(w, c.col + j)) GROUP BY c.row, c.col)
SELECT row, col, round(sqrt((gx * gx + gy * gy) / 2), 4) AS b1 FROM n""", lambda t: raster.sobel_gradient(*_cells(t)).select("row", "col", F.round("b1", 4).alias("b1")))
_add("texture_entropy", f"""WITH c AS {CELLS}, s AS (SELECT min(b2) AS lo, max(b2) AS hi FROM c), g AS (SELECT row, col, round_even((b2 - lo) / (hi - lo) * 255, 0)::INT AS g FROM c, s),
d AS (SELECT i, j FROM (SELECT unnest(range(-3, 4)) AS i), (SELECT unnest(range(-3, 4)) AS j) WHERE i * i + j * j <= 9),
n AS (SELECT t.row, t.col, v.g, count(*) AS n FROM g t, d JOIN g v ON v.row = t.row + i AND v.col = t.col + j GROUP BY ALL),
m AS (SELECT row, col, sum(n) AS total FROM n GROUP BY ALL)
SELECT row, col, round(-sum(n / total::DOUBLE * log2(n / total::DOUBLE)), 4) AS b1 FROM n JOIN m USING (row, col) GROUP BY row, col""", lambda t: raster.texture_entropy(_cells(t)[0].withColumn("b1", F.col("b2"))).select("row", "col", F.round("b1", 4).alias("b1")))
_add("clip_to_extent_null", f"SELECT (row - 1)::INT AS row, (col - 10)::INT AS col, x, y, CASE WHEN x BETWEEN 500104 AND 500300 AND y BETWEEN 5999900 AND 5999984 THEN b1 END AS b1 FROM {CELLS} WHERE col BETWEEN 10 AND 29 AND row BETWEEN 1 AND 9", lambda t: raster.clip_to_extent(*_cells(t), (500104, 5999900, 500300, 5999984), outside="null").select("row", "col", "x", "y", "b1"))
_add("clip_meta", f"SELECT 'r' AS raster_id, 20::INT AS width, (least(10, max(row) + 1) - 1)::INT AS height, 500100.0::DOUBLE AS c, 5999990.0::DOUBLE AS f FROM {CELLS}", lambda t: raster.clip_meta(_cells(t)[1], (500104, 5999900, 500300, 5999984)).select("raster_id", "width", "height", "c", "f"))
_add("resample", f"""WITH c AS {CELLS}, s AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w, floor((max(row) + 1) * 0.5)::INT AS nh, floor((max(col) + 1) * 0.5)::INT AS nw FROM c),
p AS (SELECT c.*, nh / h::DOUBLE AS sy, nw / w::DOUBLE AS sx, nh, nw FROM c, s),
q AS (SELECT tr, tc, b1, b2, greatest(0, 1 - abs((tr + 0.5) / sy - 0.5 - row) / greatest(1, 1 / sy)) * greatest(0, 1 - abs((tc + 0.5) / sx - 0.5 - col) / greatest(1, 1 / sx)) AS k
    FROM p, LATERAL (SELECT unnest(range(greatest(0, floor((row + 0.5) * sy)::INT - 2), least(nh, floor((row + 0.5) * sy)::INT + 3))) AS tr), LATERAL (SELECT unnest(range(greatest(0, floor((col + 0.5) * sx)::INT - 2), least(nw, floor((col + 0.5) * sx)::INT + 3))) AS tc))
SELECT tr::INT AS row, tc::INT AS col, round(sum(k * b1) / sum(k), 4) AS b1, round(sum(k * b2) / sum(k), 4) AS b2 FROM q WHERE k > 0 GROUP BY tr, tc""", lambda t: _rounded(raster.resample(*_cells(t), 0.5)[0].select("row", "col", "b1", "b2"), "b1", "b2", places=4))
_add("align_grids", f"""WITH c AS {CELLS}, s AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM c),
g AS (SELECT row, col, (col + 0.5) / 2 - 0.5 AS u, row::DOUBLE AS v FROM s, LATERAL (SELECT unnest(range(h)) AS row), LATERAL (SELECT unnest(range(2 * w)) AS col)),
k AS (SELECT g.row, g.col, b1, (1 - abs(v - c.row)) * (1 - abs(u - c.col)) AS k FROM g JOIN c ON c.row = v AND c.col IN (floor(u), floor(u) + 1))
SELECT g.row::INT AS row, g.col::INT AS col, round(m, 4) AS b1 FROM g LEFT JOIN (SELECT row, col, sum(k * b1) / sum(k) AS m FROM k WHERE k > 0 GROUP BY row, col) USING (row, col)""", lambda t: raster.align_grids(*_cells(t), _cells(t)[1].withColumns({"a": F.lit(5.0), "width": F.col("width") * 2})).select("row", "col", F.round("b1", 4).alias("b1")))
_add("raster_level", f"SELECT (row // 4)::INT AS row, (col // 4)::INT AS col, round(avg(b1), 4) AS b1 FROM {CELLS} GROUP BY 1, 2", lambda t: plotdata.raster_level(_cells(t)[0], 4).select("row", "col", F.round("b1", 4).alias("b1")))
_add("reproject_points", "SELECT c_custkey, round(radians(c_custkey % 360 - 180) * 6378137.0, 4) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(c_custkey % 160 - 80) / 2)), 4) AS y FROM customer", lambda t: _rounded(crs.reproject_points(t("customer").selectExpr("c_custkey", "CAST(c_custkey % 360 - 180 AS DOUBLE) AS x", "CAST(c_custkey % 160 - 80 AS DOUBLE) AS y"), "x", "y", 4326, 3857), "x", "y", places=4))


def _utm_sql() -> str:
    """The transverse Mercator series of zone 50 south, written out."""
    n, radius, alpha, _ = crs._series("wgs84")
    e = 2 * n**0.5 / (1 + n)
    sums = lambda f, g: " + ".join(f"{a!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    return f"""SELECT c_custkey, round(500000 + {crs.K0 * radius!r} * (eta + {sums('cos', 'sinh')}), 4) AS x, round(10000000 + {crs.K0 * radius!r} * (xi + {sums('sin', 'cosh')}), 4) AS y
FROM (SELECT c_custkey, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM (SELECT c_custkey, radians(lon - 117) AS dl, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t
FROM (SELECT c_custkey, 114.0::DOUBLE + (c_custkey % 60) / 10.0::DOUBLE AS lon, -35.0::DOUBLE + (c_custkey % 90) / 10.0::DOUBLE AS lat FROM customer)))"""


_add("reproject_points_utm", _utm_sql(), lambda t: _rounded(crs.reproject_points(t("customer").selectExpr("c_custkey", "114.0D + (c_custkey % 60) / 10.0D AS x", "-35.0D + (c_custkey % 90) / 10.0D AS y"), "x", "y", 4326, 32750), "x", "y", places=4))

# ---- sources, flagship ----
_add("geojson_features", "SELECT '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || c_custkey || '.0,' || c_nationkey || '.0]},\"properties\":{\"x\":' || c_custkey || ',\"lat\":' || c_nationkey || ',\"c_name\":\"' || c_name || '\"}}' AS value FROM customer", lambda t: tables.geojson_features(t("customer").selectExpr("c_custkey AS x", "c_nationkey AS lat", "c_name")))




def _geojson(t) -> DataFrame:
    """The features as they stand in the written files, read back as JSON."""
    rows = t("customer").selectExpr("c_custkey AS x", "c_nationkey AS lat", "c_name")
    path = tables.shared_path(rows.sparkSession, "geojson")
    tables.export_geojson(rows, path)
    read = rows.sparkSession.read.schema("type string, geometry struct<type: string, coordinates: array<double>>, properties struct<x: bigint, lat: int, c_name: string>").json(path)
    return read.select("type", F.col("geometry.type").alias("kind"), F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"), "properties.x", "properties.c_name")


_add("export_geojson", "SELECT 'Feature' AS type, 'Point' AS kind, c_custkey::DOUBLE AS lon, c_nationkey::DOUBLE AS lat, c_custkey AS x, c_name FROM customer", _geojson)


# readers and writers: a table goes to the shared folder and comes back
def _csv(t) -> DataFrame:
    rows = t("customer").selectExpr("c_custkey", "IF(c_custkey % 9 = 0, 'NA', CAST(c_acctbal AS STRING)) AS c_acctbal", "IF(c_custkey % 5 = 0, 'null', c_name) AS c_name", "c_nationkey")
    path = tables.shared_path(rows.sparkSession, "csv")
    tables.write_table(rows, path, "csv")
    return tables.read_csv(rows.sparkSession, path)


_add("read_csv", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name, c_nationkey::BIGINT AS c_nationkey FROM customer", _csv)


def _las(t) -> DataFrame:
    """A log file for each hundred customers, with the account balance as a curve that has gaps.

    A log's marker of gaps lies below all its values, as a balance may be any amount, also the usual -999.25.
    """
    amount = F.expr("CAST(c_acctbal AS DECIMAL(12, 2))")
    line = F.struct(F.expr("c_custkey % 100").alias("k"), F.expr("c_custkey DIV 100").alias("log"), F.col("c_nationkey").alias("nation"), F.when(F.expr("c_custkey % 7 <> 0"), F.coalesce(amount.cast("string"), F.lit("null"))).alias("balance"))
    logs = t("customer").groupBy(F.expr("c_custkey DIV 100").alias("log")).agg(F.sort_array(F.collect_list(line)).alias("rows"), (F.least(F.min(amount), F.lit(0)) - F.expr("999.25BD")).cast("string").alias("gap"))
    gap = F.coalesce("gap", F.lit("-999.25"))
    lines = F.transform("rows", lambda r: F.format_string("%d %d %d %s", r["k"], r["log"], r["nation"], F.coalesce(r["balance"], gap)))
    head = "~V\n VERS. 2.0 : v\n~W\n NULL. %s : n\n~C\n DEPT.M : depth\n LOG. : log\n NAT. : nation\n BAL.USD : balance\n~A\n"
    logs = logs.select("log", F.concat(F.format_string(head, gap), F.array_join(lines, "\n")).alias("value"))
    path = tables.shared_path(logs.sparkSession, "las")
    tables.write_table(logs, path, "text", ["log"])
    return tables.read_las(logs.sparkSession, f"{path}/log=*").select(F.col("LOG").cast("long").alias("log"), F.col("DEPT").alias("depth"), F.col("NAT").alias("nation"), F.col("BAL").alias("balance"))


_add("read_las", "SELECT (c_custkey // 100)::BIGINT AS log, (c_custkey % 100)::DOUBLE AS depth, c_nationkey::DOUBLE AS nation, CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal, 2) END AS balance FROM customer", _las)


def _written(t) -> DataFrame:
    path = tables.shared_path(t("orders").sparkSession, "orders")
    tables.write_table(t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return t("orders").sparkSession.read.parquet(path)


_add("write_table", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders", _written)


def _stored_cells(t) -> DataFrame:
    cells, meta = _cells(t)
    path = tables.shared_path(cells.sparkSession, "cells")
    tables.write_cells(cells, meta.withColumn("nodata", F.lit(5.0)), path)
    return tables.read_cells(cells.sparkSession, f"{path}/cells", f"{path}/meta")[0].select("raster_id", "row", "col", F.round("b1", 1).alias("b1"), "b2")


_add("write_cells", f"SELECT raster_id, row, col, round(b1::FLOAT::DOUBLE, 1) AS b1, CASE WHEN b2 <> 5 THEN b2 END AS b2 FROM {CELLS}", _stored_cells)


def _samples(t) -> DataFrame:
    """Graded predictions of two sessions, written as samples to two folders and merged: the correct ones of both."""
    graded = hypotheses.grade_distribution(_hypotheses(t), profile.profile(t("part").select("p_size")))
    paths = []
    for k in range(2):
        paths.append(tables.shared_path(graded.sparkSession, f"samples{k}"))
        tables.write_samples(hypotheses.to_samples(graded, "q", "c").withColumns({"session_id": F.lit(f"s{k}"), "hypothesis_index": F.lit(k)}), paths[-1])
    return tables.merge_samples(graded.sparkSession, paths).select("completion", "session_id", "specificity_score", "correct")


_add("merge_samples", f"SELECT text AS completion, 's' || k AS session_id, 2 + CASE WHEN 0.2 + n % 3 < 0.3 THEN 1 ELSE 0 END + CASE WHEN lo <> 0 AND (hi - lo) / abs(lo)::DOUBLE < 0.5 THEN 1 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS specificity_score, true AS correct FROM {H_SQL}, (SELECT unnest(range(2)) AS k) WHERE (SELECT avg(p_size) FROM part) BETWEEN lo AND hi", _samples)


def _sample_stats(t) -> DataFrame:
    """Samples of three sessions, written and read, counted by verdict."""
    graded = hypotheses.grade_distribution(_hypotheses(t), profile.profile(t("part").select("p_size")))
    path = tables.shared_path(graded.sparkSession, "samples")
    for k in range(3):
        tables.write_samples(hypotheses.to_samples(graded, "q", "c").withColumns({"session_id": F.lit(f"s{k}"), "hypothesis_index": F.lit(k)}), path)
    return tables.sample_stats(tables.read_samples(graded.sparkSession, path, correct_only=False))


_add("sample_stats", f"SELECT verdict, 3 * count(*) AS n, 3::BIGINT AS n_sessions FROM (SELECT CASE WHEN (SELECT round(avg(p_size), 4) FROM part) BETWEEN lo AND hi THEN 'correct' ELSE 'rejected' END AS verdict FROM {H_SQL}) GROUP BY verdict", _sample_stats)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assays(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    out = anomalous_groups(rows, ["Au_ppm"], "Au_ppm/l_quantity", "l_suppkey", 10)
    return _rounded(out, "Au_ppm_over_l_quantity", "Au_ppm_over_l_quantity_anom_mad")


QUERIES["flagship"] = flagship
ORACLES["flagship"] = f"""WITH a AS (SELECT l_suppkey, avg(({PARSED.format(s=SPECIAL_SQL, l=LIMIT_SQL, x=NUMBER_SQL, below=NUMBER_SQL + ' / 2')}) / nullif(l_quantity, 0)) AS r FROM {ASSAYS} GROUP BY l_suppkey), m AS (SELECT median(r) AS m, mad(r) AS s FROM a)
SELECT l_suppkey, round(r, 6) AS Au_ppm_over_l_quantity, round(0.6745 * (r - m) / s, 6) AS Au_ppm_over_l_quantity_anom_mad FROM a, m ORDER BY 3 DESC NULLS LAST, 1 LIMIT 10"""
