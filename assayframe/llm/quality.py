"""Quality rules: base rules, then robust multivariate outliers within each language and source. DataFrame functions only.

For every group (lang, source) a regularized minimum-covariance-determinant estimate of the transformed statistics is
searched by concentration: from each of STARTS, take the half of the rows nearest to the present centre, re-estimate mean
and covariance from them, and go on until the determinant stops falling. The estimate with the least determinant of all
starts is kept and reweighted: mean and covariance of all rows within the distance that 97.5 % of normal rows have. A row
is rejected whose squared Mahalanobis distance exceeds ``CUTOFF``. Equal texts of a group count once in its estimate.
Groups under ``LEAST`` rows are judged by the estimate of their language over all sources, and those of a language under
``LEAST`` rows by that of the whole table; a table under ``LEAST`` rows has its medians and quartiles, with wider deviations. Quantiles come from counts over fixed fine bins, so they are exact functions of
the rows, combine before any shuffle, and no group is gathered; group estimates are a few dozen numbers each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import scratch, stage

#: Transformed statistics and the least standard deviation each is given (documents of a group may share one value).
FEATURES = {
    "x1": ("ln(n_words)", 0.25),
    "x2": ("ln(word_chars / n_words)", 0.05),
    "x3": ("ln(1 + 100.0 * n_symbols / word_chars)", 0.15),
    "x4": ("ln(1 + n_dup_lines)", 0.35),
    "x5": ("sqrt(n_repeat_words / n_words)", 0.1),
}
NAMES = list(FEATURES)
#: Share of a group that concentration keeps, and the factor that makes the covariance of that share consistent for
#: five normal statistics: share / P(chi2 with 7 degrees <= share's quantile of chi2 with 5 degrees).
SHARE, FACTOR = 0.5, 1.9122
#: Squared distance within which rows count in the reweighted estimate (97.5 % of normal rows), and its factor.
NEAR, NEAR_FACTOR = 12.8325, 1.0555
#: Centre and scale of each start, as quantiles q1, q2, q3 of a statistic; the shorter half is not blown up by junk.
_SHORT = "2 * least(q2 - q1, q3 - q2)"
STARTS = [("q2", "q3 - q1"), ("q2", _SHORT), ("q1", _SHORT), ("q3", _SHORT)]
#: Concentration ends when the logarithm of the determinant falls by less.
FALL = 0.001
#: Squared distance above which a row is rejected: fewer than one in ten million normal rows reach it.
CUTOFF = 42.0
#: Sound texts that an estimate by concentration needs; a smaller group takes a wider one. In a table with fewer in all,
#: medians and quartiles judge, with BROAD times the least standard deviations.
LEAST, BROAD = 50, 4.0
#: Estimates, of some 200 bytes each, up to which they are broadcast to the rows; more are joined by a shuffle.
FEW = 20_000
#: An estimate's rows: those of a language and source (level 0), of a language (1, source null), or all (2, and 3 for a
#: table of few, both null).
KEYS = ["level", "lang", "source"]
BINS = 200.0

WHITE = r"[\x20\x09-\x0D]+"
INK = r"[^\x20\x09-\x0D]"


def statistics(text: str = "text") -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text column; zeros for null."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(INK))
    return {
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.expr(REPEATS).cast("long"),
    }


# Words in three-word windows that the text holds twice or more. The windows' hashes are sorted with the window's place
# in the lowest bits, as many as the text needs; neighbours whose upper bits agree are compared word by word, and the
# union of the repeated windows is summed up from the gaps between their places.
REPEATS = """
CASE WHEN size(w) < 4 THEN 0 ELSE
aggregate(array_sort(
  filter(
    transform(sequence(0, size(s) - 1), k ->
      IF((k > 0 AND shiftright(get(s, k), b) = shiftright(get(s, k - 1), b) AND slice(w, CAST(get(s, k) & m AS INT), 3) = slice(w, CAST(get(s, k - 1) & m AS INT), 3))
      OR (k < size(s) - 1 AND shiftright(get(s, k), b) = shiftright(get(s, k + 1), b) AND slice(w, CAST(get(s, k) & m AS INT), 3) = slice(w, CAST(get(s, k + 1) & m AS INT), 3)),
      CAST(get(s, k) & m AS INT), 0)),
    p -> p > 0)),
  named_struct('n', 0, 'last', -2),
  (t, p) -> named_struct('n', t.n + least(3, p - t.last), 'last', p),
  t -> t.n)
END
"""


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the statistics; every text is read once, without a shuffle."""
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), WHITE), "")
    out = docs.withColumn("w", words).withColumn("b", F.expr("CAST(ceil(log2(size(w) + 2)) AS INT)"))
    out = out.withColumn("m", F.expr("shiftleft(1L, b) - 1L"))
    hashes = "IF(size(w) < 4, CAST(array() AS array<bigint>), sort_array(transform(sequence(1, size(w) - 2), i -> (shiftleft(shiftright(xxhash64(get(w, i - 1), get(w, i), get(w, i + 1)), b), b) | CAST(i AS BIGINT)))))"
    out = out.withColumn("s", F.expr(hashes))
    return out.withColumns(statistics(text_col)).drop("w", "b", "m", "s")


def _quantiles(binned: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """For rows (keys, bin, n) the least bin up to which each share of a key's rows lies."""
    k = ", ".join(keys)
    total = binned.selectExpr(*keys, "bin", f"sum(n) OVER (PARTITION BY {k} ORDER BY bin) AS upto", f"sum(n) OVER (PARTITION BY {k}) AS total")
    return total.groupBy(*keys).agg(*[F.expr(f"min(IF(upto >= {q} * total, bin, NULL))").alias(name) for name, q in shares.items()])


def _same(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df joined with other, less its keys, where the keys are equal; null equals null."""
    other = other.withColumnsRenamed({k: f"o_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys]
    return df.join(other, on, how).drop(*[f"o_{k}" for k in keys])


def levels(sound: DataFrame) -> DataFrame:
    """(lang, source, level, feeds) of each group: the level it is judged at, and the levels whose estimates its rows belong
    to. Wider estimates are only made where a small group needs them."""
    groups = sound.groupBy("lang", "source").agg(F.count("*").alias("n"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    every = langs.agg(F.sum("n_lang").alias("n_all"), F.min("n_lang").alias("least_lang"))
    out = _same(groups, langs, ["lang"]).crossJoin(F.broadcast(every))
    out = out.withColumn("level", F.expr(f"CASE WHEN n >= {LEAST} THEN 0 WHEN n_lang >= {LEAST} THEN 1 WHEN n_all >= {LEAST} THEN 2 ELSE 3 END"))
    wide = f"array(IF(level = 0, 0, NULL), IF(least < {LEAST} AND n_lang >= {LEAST}, 1, NULL), IF(least_lang < {LEAST} AND n_all >= {LEAST}, 2, NULL), IF(level = 3, 3, NULL))"
    return out.select("lang", "source", "level", F.array_compact(F.expr(wide)).alias("feeds"))


def _at_level(level: Column) -> list[Column]:
    return [level.alias("level"), F.when(level < 2, F.col("lang")).alias("lang"), F.when(level < 1, F.col("source")).alias("source")]


ENTRIES = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]
ESTIMATE = [*[f"m_{a}" for a in NAMES], *[f"l_{a}_{b}" for a, b in ENTRIES]]


def first_estimates(rows: DataFrame) -> DataFrame:
    """Per KEYS and start the centres m_i and, as a diagonal factor, scales l_ii; quantiles are bins of a thousandth."""
    stacked = "stack(5, " + ", ".join(f"'{x}', {x}" for x in NAMES) + ") AS (feature, x)"
    binned = rows.selectExpr(*KEYS, stacked).selectExpr(*KEYS, "feature", "floor(x * 1000) AS bin")
    binned = binned.groupBy(*KEYS, "feature", "bin").agg(F.count("*").alias("n"))
    q = _quantiles(binned, [*KEYS, "feature"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    starts = F.array(*[F.struct(F.lit(k).alias("start"), F.expr(c).alias("mid"), F.expr(w).alias("width")) for k, (c, w) in enumerate(STARTS)])
    q = q.select(*KEYS, "feature", F.explode(starts).alias("s")).select(*KEYS, "feature", "s.*")
    pick = [F.expr(f"max(IF(feature = '{x}', mid, NULL)) / 1000.0D").alias(f"m_{x}") for x in NAMES]
    pick += [F.expr(f"sqrt(pow(max(IF(feature = '{x}', width, NULL)) / 1349.0D, 2) + {FEATURES[x][1] ** 2})").alias(f"l_{x}_{x}") for x in NAMES]
    zero = [F.lit(0.0).alias(f"l_{a}_{b}") for a, b in ENTRIES if a != b]
    return q.groupBy(*KEYS, "start").agg(*pick).select("*", *zero).select(*KEYS, "start", *ESTIMATE, F.lit(None).cast("double").alias("logdet"))


def moments(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Per key the means m_i, the Cholesky factor l_i_j of the regularized covariance, and its log determinant."""
    means = [F.avg(a).alias(f"m_{a}") for a in NAMES]
    products = [F.avg(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in ENTRIES]
    out = rows.groupBy(*keys).agg(*means, *products)
    for a, b in ENTRIES:
        s = f"{scale} * (p_{a}_{b} - m_{a} * m_{b})" + (f" + {FEATURES[a][1] ** 2}" if a == b else "")
        s += "".join(f" - l_{a}_{c} * l_{b}_{c}" for c in NAMES[: NAMES.index(b)])
        out = out.withColumn(f"l_{a}_{b}", F.expr(f"sqrt(greatest({s}, 1e-9))" if a == b else f"({s}) / l_{b}_{b}"))
    return out.select(*keys, *ESTIMATE, F.expr("2 * (" + " + ".join(f"ln(l_{a}_{a})" for a in NAMES) + ")").alias("logdet"))


def _few(estimates: DataFrame) -> bool:
    """Whether stored estimates are counted to be few enough to be broadcast."""
    return estimates.count() <= FEW


def distances(rows: DataFrame, estimates: DataFrame, keys: list[str], *kept: str, how: str = "inner") -> DataFrame:
    """rows with the squared distance d2 by each estimate of the same keys, and the kept columns of the estimate."""
    estimates = estimates.select(*keys, *kept, *ESTIMATE)
    out = _same(rows, F.broadcast(estimates) if _few(estimates) else estimates, keys, how)
    for i, a in enumerate(NAMES):
        s = f"{a} - m_{a}" + "".join(f" - l_{a}_{c} * z_{c}" for c in NAMES[:i])
        out = out.withColumn(f"z_{a}", F.expr(f"({s}) / l_{a}_{a}"))
    out = out.withColumn("d2", F.expr(" + ".join(f"z_{a} * z_{a}" for a in NAMES)))
    return out.select(*rows.columns, *kept, "d2")


def concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step: the nearest SHARE of each estimate's rows by the given estimates gives the next.

    The estimates with their new values, and ``going``: the determinant fell; where it rose, the old values stay.
    """
    keys = [*KEYS, "start"]
    near = distances(rows, estimates, KEYS, "start").withColumn("bin", F.expr(f"floor(ln(1 + d2) * {BINS})"))
    counts = near.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    edges = _quantiles(counts, keys, {"edge": SHARE})  # a row for each estimate
    inside = _same(near, F.broadcast(edges) if _few(estimates) else edges, keys).where("bin <= edge")
    new = moments(inside, keys, FACTOR)
    values = [*ESTIMATE, "logdet"]
    both = _same(new, estimates.withColumnsRenamed({c: f"old_{c}" for c in values}), keys)
    best = [F.expr(f"IF(old_logdet < logdet, old_{c}, {c})").alias(c) for c in values]
    return both.select(*keys, *best, F.expr(f"old_logdet IS NULL OR old_logdet - logdet >= {FALL}").alias("going"))


def least_determinant(rows: DataFrame) -> DataFrame:
    """Per KEYS the reweighted estimate around that of the least determinant; that of a table of too few rows is its medians
    and quartiles, widened."""
    first, done = stage(first_estimates(rows), "estimates"), []
    broad = {f"l_{a}_{a}": F.expr(f"sqrt(l_{a}_{a} * l_{a}_{a} + {((BROAD**2 - 1) * FEATURES[a][1] ** 2)!r}D)") for a in NAMES}
    few = first.where("level = 3 AND start = 0").withColumns(broad).select(*KEYS, *ESTIMATE, F.lit(0.0).alias("logdet"))
    going = first.where("level < 3")
    while not going.isEmpty():
        step = stage(concentrate(rows, going), "estimates")
        going = step.where("going").drop("going")
        done.append(step.where("NOT going").drop("going"))
    if not done:
        return few
    every = reduce(DataFrame.unionByName, done)
    best = every.groupBy(*KEYS).agg(F.min_by(F.struct(*ESTIMATE), F.struct("logdet", "start")).alias("e")).select(*KEYS, "e.*")
    near = distances(rows, stage(best, "estimates"), KEYS).where(f"d2 <= {NEAR}")
    return stage(moments(near, KEYS, NEAR_FACTOR).unionByName(few), "estimates")


def quality(docs: DataFrame, *, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The carried columns of docs (all by default), the statistics, base_failed, distance2 and kept.

    base_failed: fewer than 50 words, or more than half the words in repeated three-word windows. Other rows are kept
    unless they are outliers of their (lang, source); a null language or source is a group of its own. Groups under LEAST
    sound texts are judged by their language over all sources, or else by the whole table, and in a table under LEAST sound
    texts by its medians and quartiles with wide least deviations. A null text has no words and fails. Texts are taken whole
    at any length. Repeated rows and ties are judged alike. Columns of docs that clash with the added ones are replaced. An
    empty table gives no rows.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    rows = docs.select(row, F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"))
    rows = with_statistics(rows.withColumn("copy", F.xxhash64("text"))).drop("text").withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    rows = stage(rows.selectExpr("*", *[f"IF(base_failed, NULL, CAST({e} AS DOUBLE)) AS {x}" for x, (e, _) in FEATURES.items()]), "statistics")
    with scratch() as keep:
        sound = stage(rows.where("NOT base_failed").select("lang", "source", "copy", *NAMES).distinct().drop("copy"), "sound")
        groups = stage(levels(sound), "groups")
        feeds = groups.select("lang", "source", F.explode("feeds").alias("level"))
        fed = _same(sound, F.broadcast(feeds) if _few(groups) else feeds, ["lang", "source"])
        estimates = least_determinant(fed.select(*_at_level(F.col("level")), *NAMES))
        judges = groups.select("lang", "source", F.struct(*_at_level(F.col("level"))).alias("at"))
        judges = _same(judges.select(F.struct("lang", "source").alias("group"), "at.*"), estimates, KEYS).drop(*KEYS).select("group.*", "*").drop("group")
        judges = stage(judges, "judges")
        keep(judges)
    judged = distances(rows, judges, ["lang", "source"], how="left")
    kept = F.expr(f"NOT base_failed AND coalesce(d2 <= {CUTOFF}, true)")
    return judged.select("row.*", *added[:6], F.when(~F.col("base_failed"), F.col("d2")).alias("distance2"), kept.alias("kept"))
