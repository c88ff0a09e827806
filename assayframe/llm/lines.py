"""Recurring lines by a log-template tree.

The tree has a fixed depth: token count, then the first ``DEPTH`` tokens (tokens with a digit count as variable). Within a
leaf a token is stable at its place if ``min_docs`` documents' lines have it there; the others are variable fields, and
the line's template is its tokens with those generalised. A template with at least half its tokens stable that
``min_docs`` documents have is boilerplate, and so is a line that ``min_docs`` documents have word for word; such lines
are dropped. Leaves are counted with map-side combination, and distinct lines stand for all their copies, so neither a
very common line nor a large leaf meets in one task.

Documents that are copies of each other share their lines too. A document with more than half of its words in recurring
lines stays whole if it is found to be a near copy of another such document; all others lose their recurring lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import _small
from .near_dedup import near_duplicates
from .quality import WHITE
from .spark_io import discard, row_keys, scratch, stage

DEPTH, MIN_DOCS, STABLE = 3, 10, 0.5
FIELD = "<*>"


def _general(x: Column) -> Column:
    return F.when(x.rlike("[0-9]"), FIELD).otherwise(x)


def _lines(text: Column) -> Column:
    """Tokens of each line."""
    return F.transform(F.split(text, "\n"), lambda x: F.array_remove(F.split(x, WHITE), ""))


def template_lines(rows: DataFrame, min_docs: int) -> DataFrame:
    """(r1, r2, words, marks (at, n)) of the rows (r1, r2, text) with recurring lines: the words of the text, and each such
    line's place, counted from 0, and words."""
    listed = rows.select("r1", "r2", _lines(F.col("text")).alias("l"))
    path = lambda t: F.xxhash64(F.size(t), F.transform(F.slice(t, 1, DEPTH), _general))
    each = listed.select(F.explode(F.array_distinct(F.transform(F.filter("l", lambda t: F.size(t) > 0), path))).alias("leaf"))
    # repeated rows count each here, so these are all leaves that can hold a template
    leaves = stage(each.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    words = F.aggregate("l", F.lit(0), lambda n, t: n + F.size(t))
    lines = listed.select("r1", "r2", words.alias("words"), F.posexplode("l").alias("at", "t")).where(F.size("t") > 0).withColumn("leaf", path(F.col("t")))
    found = lines.join(_small(leaves), "leaf").withColumn("exact", F.xxhash64("leaf", "t", F.lit(1))).withColumn("t", F.transform("t", _general))
    found = stage(found.withColumn("id", F.xxhash64("leaf", "t")), "lines")
    docs = stage(found.groupBy("leaf", "id", "exact", "r1", "r2").agg(F.any_value("t").alias("t")), "documents")
    exact = docs.groupBy("id", "exact").agg(F.count("*").alias("n"))
    exact = stage(exact, "exact")
    distinct = docs.groupBy("leaf", "id", "r1", "r2").agg(F.any_value("t").alias("t")).groupBy("leaf", "id").agg(F.any_value("t").alias("t"), F.count("*").alias("n"))
    spread = stage(distinct.select("leaf", "id", "n", F.posexplode("t").alias("pos", "token")), "tokens")
    stable = spread.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n")).where((F.col("n") >= min_docs) & (F.col("token") != FIELD))
    marked = spread.drop("n").join(stable.withColumnRenamed("n", "m"), ["leaf", "pos", "token"], "left")
    field = F.when(F.col("m").isNotNull(), F.col("token")).otherwise(FIELD)
    shapes = marked.groupBy("leaf", "id").agg(F.sort_array(F.collect_list(F.struct("pos", field.alias("token")))).alias("p"), F.avg(F.col("m").isNotNull().cast("int")).alias("share"))
    shapes = stage(shapes.where(F.col("share") >= STABLE).select("id", F.xxhash64("leaf", "p.token").alias("template")), "templates")
    placed = docs.select("id", "r1", "r2").join(shapes, "id").select("template", "r1", "r2").distinct()
    recurring = placed.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    general = shapes.join(recurring, "template").select("id")
    good = exact.join(general, "id", "left_semi").select("exact").union(exact.where(F.col("n") >= min_docs).select("exact")).distinct()
    marks = found.join(_small(stage(good, "recurring")), "exact").groupBy("r1", "r2")
    marks = marks.agg(F.any_value("words").alias("words"), F.collect_set(F.struct("at", F.size("t").alias("n"))).alias("marks"))
    out = stage(marks, "marks")
    discard(leaves, found, docs, exact, spread, shapes)
    return out


def _lost() -> Column:
    return F.aggregate("marks", F.lit(0), lambda t, m: t + m["n"])


def copies(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """(r1, r2) of the rows (r1, r2, text) with more than half their words in the marks that are near copies of each other."""
    most = stage(marks.where(2 * _lost() > F.col("words")).select("r1", "r2"), "boilerplate")
    texts = rows.join(_small(most), ["r1", "r2"]).dropDuplicates(["r1", "r2"])
    judged = stage(near_duplicates(stage(texts, "texts"), id_col="r1"), "copies")
    several = stage(judged.where("NOT kept").select("component_id").distinct(), "copied")
    return judged.join(several, "component_id").select(F.col("doc_id").alias("r1"))


def line_dedup(docs: DataFrame, *, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, the text less its recurring lines, n_lines, n_template_lines, n_dropped and copied.

    Lines are parts between line feeds; those without words are kept and belong to no template. copied: more than half
    of the words stand in recurring lines, and another such document is a near copy (five-word shingles, a similarity of
    0.8 or more); it stays whole and is left to document-level deduplication. A null text stays null. Repeated rows count
    once towards a template and get equal results. Columns that clash with the added ones are replaced. An empty table
    gives no rows.
    """
    added = ["n_lines", "n_template_lines", "n_dropped", "copied"]
    kept = [c for c in docs.columns if c not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = docs.select(row, *row_keys(f"`{id_col}`", f"`{text_col}`"))
    text = F.col("row")[text_col]
    texts = rows.select("r1", "r2", text.alias("text"))
    with scratch() as keep:
        marks = template_lines(texts, min_docs)
        whole = copies(texts, marks).withColumn("copied", F.lit(True))
        marks = stage(marks.join(whole, "r1", "left").select("r1", "r2", "marks.at", F.coalesce("copied", F.lit(False)).alias("copied")), "marks")
        keep(marks)
    both = rows.join(marks, ["r1", "r2"], "left").withColumn("lines", F.split(text, "\n"))
    both = both.withColumns({"at": F.coalesce("at", F.array().cast("array<int>")), "copied": F.coalesce("copied", F.lit(False))})
    both = both.withColumn("cut", (F.size("at") > 0) & ~F.col("copied"))
    rest = F.when(F.col("cut"), F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("at", i)), "\n")).otherwise(text)
    columns = [rest.alias(text_col) if c == text_col else F.col("row")[c].alias(c) for c in kept]
    count = [F.coalesce(F.size("lines"), F.lit(0)), F.size("at"), F.when(F.col("cut"), F.size("at")).otherwise(0)]
    return both.select(*columns, *[c.cast("long").alias(n) for c, n in zip(count, added)], "copied")
