"""Repeated word spans by de Bruijn compaction.

Windows of ``window`` words are the edges of a de Bruijn graph, bucketed by minimizers: a run of edges with the same
words in several documents is a repeated piece. Pieces that always follow each other (one successor, one predecessor,
in every occurrence) compact into nonbranching paths through joins on the pieces. Each path's occurrences are then
checked at their source coordinates by a digest of the words themselves; edges beside branchings, which lie in pieces
seen in one document only, are compared one by one within their bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ragged import prefix, slices, span_hash, word_hashes, words
from .repeats import COUNT, FIRST, list_parts, minimizer_runs, remove_spans
from .spark_io import discard, row_keys, stage

#: Words of a minimizer.
MINIMIZER = 4


def repeated_paths(pieces: DataFrame) -> DataFrame:
    """Occurrences (head, r1, doc_id, a, n) of compacted paths, from occurrences (cid, r1, doc_id, a, n) of pieces.

    Neighbours in a document are one hop; a piece is glued to the one before when that is its only predecessor and it is
    that one's only successor. Gluing is a property of the piece, so every document compacts its occurrences alike.
    """
    along = Window.partitionBy("r1", "doc_id").orderBy("a")
    hops = pieces.withColumn("before", F.when(F.lag("a").over(along) + F.lag("n").over(along) == F.col("a"), F.lag("cid").over(along)))
    hops = hops.withColumn("after", F.when(F.lead("a").over(along) == F.col("a") + F.col("n"), F.lead("cid").over(along)))
    degree = hops.groupBy("cid").agg(
        F.when(F.count("before") == F.count("*"), F.when(F.min("before") == F.max("before"), F.min("before"))).alias("only_before"),
        F.when(F.count("after") == F.count("*"), F.when(F.min("after") == F.max("after"), F.min("after"))).alias("only_after"),
    )
    back = degree.where("only_after is not null").select(F.col("cid").alias("only_before"), F.col("only_after").alias("cid"))
    glued = degree.where("only_before is not null").select("cid", "only_before").join(back, ["cid", "only_before"]).select("cid", F.lit(True).alias("glued"))
    marked = pieces.join(glued, "cid", "left")
    path = F.sum(F.when(F.col("glued"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("path", path).groupBy("r1", "doc_id", "path").agg(F.min_by("cid", "a").alias("head"), F.min("a").alias("a"), F.sum("n").cast("int").alias("n"))


def evidence(rows: DataFrame, window: int) -> DataFrame:
    """What the texts of rows (r1, doc_id, text, spans, edges) hold at the asked places.

    For a span (head, a, n) one row (head, digest, a, n); for edges (key, a, n) one row (key, hash, a + i, 1) each.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_struct_array(pa.StructArray.from_arrays(batch.columns, batch.schema.names).filter(pc.or_(pc.is_valid(batch.column(3)), pc.is_valid(batch.column(4)))))
            at_s, s = list_parts(batch.column(3), "head", "a", "n")
            at_e, e = list_parts(batch.column(4), "key", "a", "n")
            for i, j, data, bounds in slices(batch.column(2)):
                start, end, edge = words(data, bounds)
                raw = data.tobytes()
                p = prefix(word_hashes(data, start, end))
                doc, k1, k2, a, n, whole = [], [], [], [], [], []
                lo, hi = at_s[i], at_s[j]
                own = np.repeat(np.arange(j - i), np.diff(at_s[i : j + 1]))
                first = edge[:-1][own] + s["a"][lo:hi]
                last = first + s["n"][lo:hi] + window - 1
                digests = [int.from_bytes(hashlib.blake2b(b" ".join([raw[x:y] for x, y in zip(start[f:g].tolist(), end[f:g].tolist())]), digest_size=8).digest(), "big", signed=True) for f, g in zip(first.tolist(), last.tolist())]
                doc.append(own), k1.append(s["head"][lo:hi]), k2.append(np.array(digests, np.int64)), a.append(s["a"][lo:hi]), n.append(s["n"][lo:hi]), whole.append(np.ones(hi - lo, bool))
                lo, hi = at_e[i], at_e[j]
                count = e["n"][lo:hi].astype(np.int64)
                own = np.repeat(np.repeat(np.arange(j - i), np.diff(at_e[i : j + 1])), count)
                place = np.repeat(e["a"][lo:hi], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                first = edge[:-1][own] + place
                doc.append(own), k1.append(np.repeat(e["key"][lo:hi], count)), k2.append(span_hash(p, first, first + window).view(np.int64)), a.append(place), n.append(np.ones(len(own), np.int64)), whole.append(np.zeros(len(own), bool))
                doc = np.concatenate(doc)
                columns = [np.concatenate(k1).astype(np.int64), np.concatenate(k2), np.concatenate(a).astype(np.int32), np.concatenate(n).astype(np.int32), np.concatenate(whole)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).take(pa.array(doc)) for c in range(2)), *map(pa.array, columns)], names=["r1", "doc_id", "k1", "k2", "a", "n", "whole"])

    return rows.select("r1", "doc_id", "text", "spans", "edges").mapInArrow(read, f"r1 bigint, doc_id {kind}, k1 bigint, k2 bigint, a int, n int, whole boolean")


def repeated_spans(rows: DataFrame, window: int) -> DataFrame:
    """(r1, doc_id, a, n): windows of rows (r1, doc_id, text) that also start in a document with a smaller doc_id."""
    ids = ["r1", "doc_id"]
    runs = minimizer_runs(rows.where("doc_id is not null"), ids, window, min(MINIMIZER, window), "word")
    # tables of their own, so that the joins deal out the runs anew and can split a key that very many of them have
    keys = stage(runs.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key", "lo"), "keys")
    found = stage(runs.join(keys, "key"), "runs")
    classes = found.groupBy("key", "ctx").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("lo").alias("lo"))
    # an edge beside a branching can only be repeated if its bucket has pieces of several first documents
    branched = classes.groupBy("key").agg(F.max("first").alias("late"), F.min("lo").alias("lo")).where("late > lo").select("key", F.lit(True).alias("branched"))
    classes = stage(classes.select("key", "ctx", "first", "last").join(branched, "key", "left"), "pieces")
    known = found.join(classes, ["key", "ctx"]).where("first < last OR branched AND doc_id = first")
    known = stage(known.select(*ids, "key", F.xxhash64("key", "ctx").alias("cid"), F.expr(FIRST), F.expr(COUNT), F.expr("first < last").alias("repeated"), F.expr("coalesce(branched, false) AND doc_id = first").alias("edge")), "occurrences")
    discard(keys, found, classes)
    paths = repeated_paths(known.where("repeated").select("cid", *ids, "a", "n"))
    spans = paths.groupBy(*ids).agg(F.collect_list(F.struct("head", "a", "n")).alias("spans"))
    edges = known.where("edge").groupBy(*ids).agg(F.collect_list(F.struct("key", "a", "n")).alias("edges"))
    asked = stage(spans.join(edges, ids, "full"), "asked")
    discard(known)
    seen = stage(evidence(rows.join(asked, ids), window), "evidence")
    discard(asked)
    least = seen.groupBy("k1", "k2", "whole").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    spans = stage(seen.join(stage(least, "repeats"), ["k1", "k2", "whole"]).where("lo < doc_id").select(*ids, "a", "n"), "spans")
    discard(seen)
    return spans


def substring_dedup(docs: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_text (words joined by one space, as bytes), kept_sha256 for every row.

    Words are runs without ASCII white space, unchanged. A word goes if a window over it also starts in a document with a
    smaller doc_id. A null text has no words; a null doc_id is neither smaller than another nor has a smaller one. Rows
    that share a doc_id are one document here: they do not remove from each other. An empty table gives no rows; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select(row_keys("doc_id", "text")[0], "doc_id", "text")
    out = remove_spans(rows, repeated_spans(rows, window), ["r1", "doc_id"], window, "word")
    return out.withColumnRenamed("n_units", "n_words")
