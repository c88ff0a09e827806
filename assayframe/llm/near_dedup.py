"""Near-duplicate documents by a signature-coordinate inverted join.

1. Each text's distinct word shingles give a 128-bit set fingerprint and a signature of H minima. Texts with equal sets
   form one class, so copies are never paired.
2. Each class is posted under its (coordinate, value) pairs, 64 bits each, so strangers hardly ever share a list. Two signatures that agree in T places share one of any
   H - T + 1 of them, so only the rarest H - T + 1 are kept (prefix merging); pairs that occur once take up places of
   the prefix but need no list, and the commonest lists are skipped.
3. In each list the class with most shared coordinates leads and is paired with the others. A pair goes on if its sizes
   and the bitmaps of its sets allow a link and its signatures collide in T places or more; then the full sets decide.
4. Lists whose members then still lie in different components are merged again under further leaders, members of the
   same component being skipped, until no pair that could add a link is left. The same conditions are put to a pair
   before it is made, and it is made in the first list only that has both. No list is expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .encode import distinct
from .ragged import LOWER, mix, prefix, slices, span_hash, word_hashes, words
from .spark_io import scratch, stage

#: Coordinates of a signature, and matches from which full sets are compared. At a similarity of 0.8 fewer than 36 of 64
#: match with a probability of 4 in a million.
COORDINATES, MATCHES = 64, 36
#: 64-bit words of a set's bitmap, and of the signature's lowest bytes.
WORDS, SKETCH = 16, COORDINATES // 8
MARKS = [*[f"w{k}" for k in range(WORDS)], *[f"s{k}" for k in range(SKETCH)]]
#: Ids up to which those asked for are broadcast, 16 MB of hashes.
ASKED = 2_000_000
_FACTORS = np.random.default_rng(64).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in lower case (ASCII), and bounds; a shorter text is one shingle."""
    low = LOWER[data]
    start, end, at = words(low, bounds)
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    edge = np.concatenate([[0], np.cumsum(count)])
    if not edge[-1]:
        return np.zeros(0, np.uint64), edge
    doc = np.repeat(np.arange(len(n)), count)
    first = at[:-1][doc] + np.arange(edge[-1]) - edge[:-1][doc]
    return span_hash(prefix(word_hashes(low, start, end)), first, first + np.minimum(k, n)[doc]), edge


def signatures(docs: DataFrame, *, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), sig (null for a text without words), and MARKS.

    A coordinate's 64 bits are its least hash mixed with the coordinate's own factor, so they stand for both.

    The bitmap w0, w1 ... has a bit for the hash of each shingle; s0, s1 ... hold the lowest byte of each coordinate.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in slices(batch.column(1)):
                h, edge = shingle_hashes(data, bounds, shingle)
                n = np.zeros(j - i, np.int64)
                prints = np.zeros((2, j - i), np.uint64)
                sig = np.zeros((j - i, COORDINATES), np.uint64)
                bits = np.zeros((j - i) * 64 * WORDS, bool)
                full = np.flatnonzero(np.diff(edge))
                if len(full):
                    doc = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(edge))
                    first = np.zeros(len(h), bool)
                    first[distinct(mix(h + mix(doc + np.uint64(1))))[0]] = True
                    bits[(doc * np.uint64(64 * WORDS) + (h >> np.uint64(32)) % np.uint64(64 * WORDS)).astype(np.int64)] = True
                    at = edge[full]
                    n[full] = np.add.reduceat(first.astype(np.int64), at)
                    for k in (0, 1):
                        prints[k, full] = np.add.reduceat(np.where(first, mix(h ^ _FACTORS[k]), np.uint64(0)), at)
                    for k in range(COORDINATES):
                        sig[full, k] = mix(np.minimum.reduceat(h * _FACTORS[k], at) ^ _FACTORS[k])
                off = np.concatenate([[0], np.cumsum(np.where(n > 0, COORDINATES, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(sig[n > 0].ravel().view(np.int64)), mask=pa.array(n == 0))
                marks = np.hstack([np.packbits(bits, bitorder="little").view("<i8").reshape(j - i, WORDS), sig.astype(np.uint8).view("<i8")])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *(pa.array(p.view(np.int64)) for p in prints), lists, *(pa.array(m.copy()) for m in marks.T)], names=["doc_id", "n_shingles", "f1", "f2", "sig", *MARKS])

    return rows.mapInArrow(sign, f"doc_id {kind}, n_shingles bigint, f1 bigint, f2 bigint, sig array<bigint>, {', '.join(f'{m} bigint' for m in MARKS)}")


def shingle_sets(docs: DataFrame, *, shingle: int) -> DataFrame:
    """(rep, members): the distinct shingle hashes of the text of each row (rep, text)."""
    kind = docs.schema["rep"].dataType.simpleString()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in slices(batch.column(1)):
                h, edge = shingle_hashes(data, bounds, shingle)
                sets = [np.unique(h[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                off = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["rep", "members"])

    return docs.select("rep", "text").mapInArrow(collect, f"rep {kind}, members array<bigint>")


def could_link(percent: int) -> str:
    """Condition on the sizes and marks of two sides a_ and b_: false only if the sets cannot be linked, or fewer than
    MATCHES coordinates collide.

    A bit that only one set has stands for at least one member that the other lacks; one of two coordinates whose lowest
    bytes differ is no collision.
    """
    size = "(a_n_shingles + b_n_shingles)"
    least = f"100 * least(a_n_shingles, b_n_shingles) >= {percent} * greatest(a_n_shingles, b_n_shingles)"
    lacks = lambda a, b: " + ".join(f"bit_count({a}_w{k} & ~{b}_w{k})" for k in range(WORDS))
    enough = lambda a, b: f"{100 + percent} * ({a}_n_shingles - ({lacks(a, b)})) >= {percent} * {size}"
    fold = lambda x, by: f"({x} | shiftrightunsigned({x}, {by}))"
    differ = " + ".join(f"bit_count({fold(fold(fold(f'(a_s{k} ^ b_s{k})', 4), 2), 1)} & 72340172838076673L)" for k in range(SKETCH))
    return f"{least} AND {COORDINATES} - ({differ}) >= {MATCHES} AND {enough('a', 'b')} AND {enough('b', 'a')}"


def _side(marked: DataFrame, side: str, *kept: str) -> DataFrame:
    """Sizes and marks of classes as one side of a pair."""
    return marked.select(F.col("rep").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n_shingles", *MARKS, *kept)])


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a stored table whose full sets are similar enough."""
    if 2 * pairs.count() <= ASKED:  # 8 bytes each: sets that no pair asks for stay out of the joins
        asked = pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("h"))
        sets = sets.join(F.broadcast(asked), F.xxhash64("rep") == asked.h, "left_semi")
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("members").alias(f"m{side}")), side)
    both = F.size(F.array_intersect("ma", "mb"))
    return pairs.where(both * 100 >= (F.size("ma") + F.size("mb") - both) * percent).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Texts are linked when 100 * common shingles >= percent * all shingles of both; component_id is the least doc_id in
    reach. A null text and one without words has no shingles, is linked with nothing and kept. A null doc_id is never a
    component's least one, and a text that only rows with a null doc_id have links nothing. Rows that share a doc_id count
    as one document with all their texts, and are kept or not together. Texts are taken whole at any length. An empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with scratch() as keep:
        signed = stage(signatures(rows, shingle=shingle, id_col="doc_id", text_col="text"), "signatures")
        kept = ["n_shingles", "sig", *MARKS]
        reps = signed.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct(*kept), "doc_id").alias("x"))
        reps = stage(reps.where("rep is not null").select("f1", "f2", "rep", "x.*"), "classes")

        post = reps.select("rep", F.explode("sig").alias("cv"))
        often = post.groupBy("cv").agg(F.count("*").alias("f")).where("f > 1")
        shared = post.join(often, "cv").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "cv"))).alias("p")).where(F.size("p") >= MATCHES)
        prefixes = stage(shared.select("rep", F.size("p").alias("p"), F.expr(f"slice(p.cv, 1, size(p) - {MATCHES - 1})").alias("pre")), "postings")
        lists = prefixes.select("rep", "p", F.explode("pre").alias("cv"))

        marked = stage(prefixes.join(reps.select("rep", "n_shingles", *MARKS), "rep"), "marks")
        wanted = prefixes.select("rep").distinct()
        sets = stage(shingle_sets(rows.join(wanted, rows.doc_id == wanted.rep).select("rep", "text"), shingle=shingle), "shingles")

        lead = lists.groupBy("cv").agg(F.max_by("rep", F.struct("p", "rep")).alias("a"), F.count("*").alias("n")).where("n > 1").select("cv", "a")
        lead = stage(lead, "leaders")
        live = lists.select("cv", "rep").join(lead, "cv").where("rep <> a")
        tested = stage(live.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct(), "pairs")
        pairs = tested.join(_side(marked, "a"), "a").join(_side(marked, "b"), "b").where(could_link(percent)).select("a", "b")
        labels = stage(connected_components(links(stage(pairs, "candidates"), sets, percent), lambda e: stage(e, "links")), "labels")
        live, leaders = live.select("cv", "rep"), 64
        while True:
            live = stage(live.join(labels, live.rep == labels.id, "left").select("cv", "rep", F.coalesce("component", "rep").alias("comp")), "lists")
            # the members of a list's smallest components lead next, so one stranger to a large component costs one round;
            # a list's largest component only follows, and a list with one component is done
            order, whole = Window.partitionBy("cv").orderBy("n", "comp"), Window.partitionBy("cv")
            groups = live.groupBy("cv", "comp").agg(F.count("*").alias("n"))
            groups = groups.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            groups = groups.withColumn("others", F.max("before").over(whole)).where("before < others")
            groups = stage(groups, "groups")
            if groups.isEmpty():
                break
            heads = live.join(groups.where(F.col("before") < leaders), ["cv", "comp"]).withColumn("k", F.row_number().over(Window.partitionBy("cv").orderBy("n", "comp", "rep")))
            heads = stage(heads.where(F.col("k") <= leaders).select("cv", F.col("rep").alias("a"), F.col("comp").alias("ca")), "leaders")
            ahead = stage(heads.join(_side(marked, "a", "pre"), "a"), "leaders")
            follow = live.join(groups, "cv", "left_semi").select("cv", F.col("rep").alias("b"), F.col("comp").alias("cb")).join(_side(marked, "b", "pre"), "b")
            pairs = follow.join(ahead, "cv").where(f"ca <> cb AND {could_link(percent)} AND cv = array_intersect(a_pre, b_pre)[0]")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct()
            pairs = stage(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            found = stage(links(pairs.select("a", "b"), sets, percent), "links")
            if not found.isEmpty():
                # what is linked now are components: their links are few, and the labels follow them
                joined = pairs.join(found, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
                joined = connected_components(joined, lambda e: stage(e, "links")).select(F.col("id").alias("component"), F.col("component").alias("new"))
                known = labels.unionByName(pairs.select(F.explode(F.array("ca", "cb")).alias("id")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("component")))
                labels = stage(known.join(joined, "component", "left").select("id", F.coalesce("new", "component").alias("component")), "labels")
            live = live.join(groups.where(F.col("others") > leaders), "cv", "left_semi").join(heads.select("cv", F.col("a").alias("rep")), ["cv", "rep"], "left_anti").select("cv", "rep")
            leaders *= 16
        keep(signed, reps, labels)
    classes = reps.join(labels, reps.rep == labels.id, "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
