"""Predictions about results: parsing, specificity, grading, and training samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HYPOTHESIS = (
    "text string, claim_type string, column_a string, column_b string, direction string, magnitude_range array<double>, value_range array<double>, "
    "expected_count bigint, count_range array<bigint>, cluster_id bigint, threshold double, reasoning string"
)
FIELDS = [f.split()[0] for f in HYPOTHESIS.split(", ")]
#: Thresholds up to which they are broadcast, 8 bytes each.
FEW = 100_000


def parse_hypotheses(responses: DataFrame, id_col: str = "response_id", text_col: str = "response") -> DataFrame:
    """(id, nth, fields of HYPOTHESIS): a response's JSON array of objects, or else its numbered lines as general claims.

    The array spans the first [ to the last ]. A line starts with digits, dashes, stars or bullets and a dot or bracket.
    """
    t = F.col(text_col)
    whole = F.from_json(F.regexp_extract(t, r"(?s)\[.*\]", 0), f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in HYPOTHESIS.split(', '))}>>")
    parsed = responses.select(F.col(id_col), t.alias("_t"), F.filter(whole, lambda x: x.isNotNull()).alias("_j"))
    is_json = F.coalesce(F.size("_j") > 0, F.lit(False))
    objects = parsed.where(is_json).select(id_col, F.posexplode("_j").alias("nth", "h")).select(id_col, "nth", "h.*")
    lines = parsed.where(~is_json).select(id_col, F.posexplode(F.split("_t", "\n")).alias("nth", "line"))
    text = F.regexp_extract(F.trim("line"), r"^[\d\-\*•]+[.)]\s*(.+)$", 1)
    lines = lines.withColumn("text", F.trim(text)).where("text <> ''")
    blank = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in HYPOTHESIS.split(", ") if f.split()[0] not in ("text", "claim_type")}
    lines = lines.withColumn("claim_type", F.lit("general")).withColumns(blank).select(id_col, "nth", *FIELDS)
    return objects.select(id_col, "nth", *FIELDS).unionByName(lines).withColumn("claim_type", F.coalesce("claim_type", F.lit("general")))


def specificity_score() -> Column:
    """0 to 5: columns named, ranges given, narrow ranges, a reason of more than 20 characters."""
    one = lambda test: F.coalesce(test.cast("int"), F.lit(0))
    width = lambda r: F.get(F.col(r), 1) - F.get(F.col(r), 0)
    low = F.get(F.col("value_range"), 0)
    any_range = F.col("magnitude_range").isNotNull() | F.col("value_range").isNotNull() | F.col("count_range").isNotNull()
    score = one(F.col("column_a").isNotNull() & (F.col("column_a") != "")) + one(F.col("column_b").isNotNull() & (F.col("column_b") != "")) + one(any_range)
    score += one(width("magnitude_range") < 0.3) + one(F.try_divide(width("value_range"), F.abs(low)) < 0.5) + one(F.length("reasoning") > 20)
    return F.least(score, F.lit(5))


def _within(x: Column, r: str) -> Column:
    return F.when(F.col(r).isNotNull(), x.between(F.get(F.col(r), 0), F.get(F.col(r), 1)))


def _graded(h: DataFrame, actual: Column, correct: Column) -> DataFrame:
    """h with actual_value, null where there is nothing to grade by, and is_correct, null also where nothing is claimed."""
    return h.withColumns({"actual_value": actual.cast("double"), "is_correct": F.when(actual.isNotNull(), correct)})


def _correlation_verdict(r: Column) -> Column:
    way = F.when(F.col("direction") == "positive", r > 0).when(F.col("direction") == "negative", r < 0).when(F.col("direction") == "none", F.abs(r) <= 0.1).otherwise(True)
    return way & F.coalesce(_within(r, "magnitude_range"), F.lit(True))


def grade_correlation(h: DataFrame, pairs: DataFrame) -> DataFrame:
    """Correlation claims against (col_a, col_b, r): direction (none: |r| <= 0.1) and magnitude range both have to hold."""
    both = pairs.select("col_a", "col_b", "r").union(pairs.select("col_b", "col_a", "r")).dropDuplicates(["col_a", "col_b"])
    out = h.join(both, (h.column_a == both.col_a) & (h.column_b == both.col_b), "left")
    return _graded(out, F.col("r"), _correlation_verdict(F.col("r"))).drop("col_a", "col_b", "r")


def grade_distribution(h: DataFrame, stats: DataFrame) -> DataFrame:
    """Whether the mean of column_a (stats: column, mean) lies in value_range; without a range there is no verdict."""
    out = h.join(stats.select("column", "mean"), h.column_a == F.col("column"), "left")
    return _graded(out, F.col("mean"), _within(F.col("mean"), "value_range")).drop("column", "mean")


def _cluster_verdict(k: Column, size: Column) -> tuple[Column, Column]:
    """(actual value, verdict) from the number of clusters and the size of cluster_id, null if there is no such cluster.

    A count range or an expected count speaks of the number of clusters; without them cluster_id's size has to lie in
    value_range, and a cluster that isn't there makes the claim wrong.
    """
    counts = F.col("count_range").isNotNull() | F.col("expected_count").isNotNull()
    actual = F.when(counts, k).when(F.col("cluster_id").isNotNull(), size)
    fits = F.coalesce(_within(k, "count_range"), k == F.col("expected_count"))
    own = F.when(size.isNull(), F.lit(False)).otherwise(_within(size, "value_range"))
    some = k > 0  # without clusters there is nothing to grade by
    return F.when(some, actual).cast("double"), F.when(some, F.when(counts, fits).when(F.col("cluster_id").isNotNull(), own))


def grade_cluster(h: DataFrame, sizes: DataFrame) -> DataFrame:
    """The number of clusters in count_range or equal to expected_count, or else the size of cluster_id in value_range;
    sizes: cluster, size."""
    own = h.join(sizes, h.cluster_id == F.col("cluster"), "left").join(F.broadcast(sizes.agg(F.count("*").alias("_k"))))
    actual, correct = _cluster_verdict(F.col("_k"), F.col("size"))
    return own.withColumns({"actual_value": actual, "is_correct": correct}).drop("cluster", "size", "_k")


def _anomaly_verdict(n: Column) -> Column:
    close = F.abs(n - F.col("expected_count")) <= F.greatest(F.lit(1.0), 0.1 * F.col("expected_count"))
    return F.coalesce(_within(n, "count_range"), close)


def grade_anomaly(h: DataFrame, counts: DataFrame) -> DataFrame:
    """Anomalies of column_a (counts: column, n) in count_range, or within max(1, 10 %) of expected_count."""
    out = h.join(counts, h.column_a == F.col("column"), "left")
    return _graded(out, F.col("n"), _anomaly_verdict(F.col("n"))).drop("column", "n")


def _above(df: DataFrame, columns: list[str], claims: DataFrame) -> DataFrame:
    """(column, t, n): how many values of a column lie above each threshold of claims (column, t).

    Values are counted between neighbouring thresholds, and these counts are summed up from the top, so a value goes to one
    place however many thresholds its column has. Thresholds are ordered within a column, one row each.
    """
    cuts = claims.groupBy("column").agg(F.sort_array(F.collect_set("t")).alias("cuts"))
    long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "column", "v").where("v IS NOT NULL")
    middle = "shiftright(s.a + s.b, 1)"  # a binary search: how many thresholds are below v
    half = f"CASE WHEN s.a >= s.b THEN s WHEN cuts[{middle}] < v THEN struct({middle} + 1 AS a, s.b AS b) ELSE struct(s.a AS a, {middle} AS b) END"
    place = F.expr(f"aggregate(sequence(1, CAST(ceil(log2(size(cuts) + 1)) AS INT)), struct(0 AS a, size(cuts) AS b), (s, i) -> {half}).a")
    counted = long.join(F.broadcast(cuts) if claims.count() <= FEW else cuts, "column").select("column", place.alias("below")).groupBy("column", "below").agg(F.count("*").alias("k"))
    steps = cuts.select("column", F.posexplode("cuts").alias("i", "t")).withColumn("below", F.col("i") + 1)
    above = Window.partitionBy("column").orderBy(F.desc("below"))
    out = steps.join(counted, ["column", "below"], "left").withColumn("n", F.sum(F.coalesce("k", F.lit(0))).over(above))
    return out.select("column", "t", "n")


def grade_existence(h: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Whether any value of column_a lies above the threshold; the actual value is how many do."""
    claims = h.where(F.col("column_a").isin(columns) & F.col("threshold").isNotNull()).select(F.col("column_a").alias("column"), F.col("threshold").alias("t")).distinct()
    found = _above(df, columns, claims)
    out = h.join(found, (h.column_a == F.col("column")) & (h.threshold == F.col("t")), "left")
    return _graded(out, F.col("n"), F.col("n") > 0).drop("column", "t", "n")


#: Names of a result's count, the first that is there counts.
COUNT_NAMES = ["count", "total", "n", "matching_rows", "total_rows"]


def grade_count(h: DataFrame, result: dict[str, float]) -> DataFrame:
    """The result's count in count_range or equal to expected_count."""
    value = next((result[k] for k in COUNT_NAMES if k in result), None)
    actual = F.lit(value).cast("double")
    return _graded(h, actual, F.coalesce(_within(actual, "count_range"), actual == F.col("expected_count")))


def evaluate(
    h: DataFrame,
    *,
    pairs: DataFrame | None = None,
    stats: DataFrame | None = None,
    clusters: DataFrame | None = None,
    anomalies: DataFrame | None = None,
    rows: DataFrame | None = None,
    columns: list[str] | None = None,
    result: dict[str, float] | None = None,
) -> DataFrame:
    """h with actual_value and is_correct, each claim graded by its claim_type.

    correlation takes pairs (col_a, col_b, r), distribution stats (column, mean), cluster clusters (cluster, size), anomaly
    anomalies (column, n; a claim that names no column takes their sum), existence rows with their columns, and count the
    result's numbers. A claim whose grader has no input, and one of another type (comparison, trend, general, an unknown
    one or null), keeps null in both.

    Facts of all types stand in one table, keyed by claim_type and what the type looks up: a pair, a column, a cluster, or a
    column and a threshold. The claims are read once and joined with it once.
    """
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    facts: list[DataFrame] = []

    def add(kind: str, table: DataFrame, one: Column, two: Column, value: Column) -> None:
        facts.append(table.select(F.lit(kind).alias("f_type"), one.alias("f_one"), two.alias("f_two"), value.cast("double").alias("f_value")))

    if pairs is not None:
        both = pairs.select("col_a", "col_b", "r").union(pairs.select("col_b", "col_a", "r")).dropDuplicates(["col_a", "col_b"])
        add("correlation", both, F.col("col_a"), F.col("col_b"), F.col("r"))
    if stats is not None:
        add("distribution", stats, F.col("column"), none, F.col("mean"))
    if clusters is not None:
        add("cluster", clusters.where("cluster IS NOT NULL"), text("cluster"), none, F.col("size"))
    if anomalies is not None:
        add("anomaly", anomalies.where("column IS NOT NULL"), F.col("column"), none, F.col("n"))
        add("anomaly", anomalies.agg(F.sum("n").alias("n")), none, none, F.col("n"))
    if rows is not None:
        asked = h.where((F.col("claim_type") == "existence") & F.col("column_a").isin(columns or []) & F.col("threshold").isNotNull())
        asked = asked.select(F.col("column_a").alias("column"), F.col("threshold").alias("t")).distinct()
        add("existence", _above(rows, columns or [], asked), F.col("column"), text("t"), F.col("n"))
    table = reduce(DataFrame.unionByName, facts, h.sparkSession.createDataFrame([], "f_type string, f_one string, f_two string, f_value double"))

    kind = F.col("claim_type")
    first = F.when(kind.isin("correlation", "distribution", "anomaly", "existence"), F.col("column_a")).when(kind == "cluster", text("cluster_id"))
    second = F.when(kind == "correlation", F.col("column_b")).when(kind == "existence", text("threshold"))
    keyed = h.withColumns({"_one": first, "_two": second})
    out = keyed.join(table, (kind == F.col("f_type")) & F.col("_one").eqNullSafe(F.col("f_one")) & F.col("_two").eqNullSafe(F.col("f_two")), "left")
    number = clusters.agg(F.count("*").alias("_k")) if clusters is not None else h.sparkSession.range(1).select(F.lit(0).cast("long").alias("_k"))
    out = out.join(F.broadcast(number))

    v = F.col("f_value")
    count = F.lit(next((result[k] for k in COUNT_NAMES if k in result), None) if result else None).cast("double")
    size, is_right = _cluster_verdict(F.col("_k"), v)
    actual = F.when(kind == "cluster", size).when(kind == "count", count).when(kind.isin("correlation", "distribution", "anomaly", "existence"), v)
    correct = (
        F.when(kind == "correlation", _correlation_verdict(v))
        .when(kind == "distribution", _within(v, "value_range"))
        .when(kind == "anomaly", _anomaly_verdict(v))
        .when(kind == "existence", v > 0)
        .when(kind == "count", F.coalesce(_within(count, "count_range"), count == F.col("expected_count")))
    )
    correct = F.when(kind == "cluster", is_right).when(actual.isNotNull(), correct)
    return out.withColumns({"actual_value": actual, "is_correct": correct}).select(*h.columns, "actual_value", "is_correct")


#: Text of a sample's prompt; {question} and {code} are filled in.
PROMPT = "{question}\n\nSteps that ran:\n{code}\n\nWhat will they show? Name the columns, and how large the effect or the count will be."


def to_samples(graded: DataFrame, question: str, code: str, template: str = PROMPT) -> DataFrame:
    """Training samples of the graded predictions: prompt, completion, score, verdict; ungraded ones are left out."""
    prompt = template.format(question=question, code=code)
    out = graded.where("is_correct IS NOT NULL")
    return out.select(F.lit(prompt).alias("prompt"), F.col("text").alias("completion"), specificity_score().alias("specificity_score"), F.col("is_correct").alias("correct"), "claim_type", F.col("actual_value").cast("string").alias("actual_value"), F.when(F.col("is_correct"), "correct").otherwise("rejected").alias("verdict"))


def sample_report(samples: DataFrame) -> DataFrame:
    """verdict, n, mean_score."""
    return samples.groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("specificity_score"), 4).alias("mean_score"))
