"""Benchmark passages in documents by a distributed positional inverted index. DataFrame functions only.

1. Every item gives its phrases (windows of ``window`` words; a shorter item is one phrase). The corpus frequency of the
   test words is counted, and each phrase is looked up by its ``TERMS`` rarest words.
2. Postings (term, document, position) of those words are stored in the shared folder.
3. Posting lists are shifted by each word's offset in the phrase and intersected: a place that all looked-up words of a
   phrase agree on is a candidate start.
4. Candidates meet their document once, where the whole phrase is compared, so matches are exact.
5. Asked for a ``slop``, phrases are also looked for by proximity: places that three of a phrase's four rarest words of the
   corpus agree on within so many words are candidates, and match if a share of the phrase's words stands there. One of the
   two rarest is always among the three, so the postings of the other two are not needed: the text around is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_io import row_keys, stage

#: Words of a phrase whose postings are intersected.
TERMS = 2
#: Proximity: words looked up, how many of them have to meet, the share of a phrase's distinct words that has to stand at
#: a place, and the least words of a phrase that is looked for in this way.
NEAR_TERMS, NEAR_MEET, NEAR_SHARE, NEAR_LEAST = 4, 3, 0.75, 8
#: So many of the rarest looked-up words that one of them is always among those that meet.
NEAR_ANCHORS = NEAR_TERMS - NEAR_MEET + 1
#: Rows up to which a word table is broadcast; above, the join shuffles.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: str) -> Column:
    """Words in lower case (ASCII), an empty array for null."""
    t = F.col(text)
    # lower() is fast but also lowers capitals beyond ASCII, so only texts without such bytes take it
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, BREAKS), ""), F.array().cast("array<string>"))


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def phrases(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(phrase array, items array): the distinct phrases of all items."""
    words = items.select(F.col(id_col).alias("item"), word_list(text_col).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = words.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, window).alias("phrase"))
    return each.groupBy("phrase").agg(F.collect_set("item").alias("items"))


def corpus_frequency(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n): how often each word of the table occurs in the documents, one row for each word that does."""
    every = docs.select(F.explode(word_list("text")).alias("word"))
    return every.join(_small(words), "word").groupBy("word").agg(F.count("*").alias("n"))


def lookup_terms(phrase_table: DataFrame, docs: DataFrame, terms: int = TERMS) -> DataFrame:
    """(phrase_id, word, off, k, len, need, whole) of each phrase's rarest words that the corpus has, k from 1 on.

    whole: the corpus has all words of the phrase. need: the words of a whole phrase to be intersected.
    """
    spread = phrase_table.select("phrase_id", F.size("phrase").alias("len"), F.posexplode("phrase").alias("off", "word"))
    often = corpus_frequency(docs, spread.select("word").distinct())
    whole = Window.partitionBy("phrase_id")
    ranked = spread.join(often, "word").withColumn("whole", F.count("*").over(whole) == F.col("len"))
    ranked = ranked.withColumn("k", F.row_number().over(whole.orderBy("n", "off"))).where(F.col("k") <= terms)
    return ranked.select("phrase_id", "word", "off", "k", "len", F.least("len", F.lit(TERMS)).alias("need"), "whole")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, r1, r2, pos) wherever a document has one of the terms (word), once however often the row is repeated."""
    every = docs.select("r1", "r2", F.posexplode(word_list("text")).alias("pos", "word"))
    return every.join(_small(terms.select("word").distinct()), "word").select("word", "r1", "r2", "pos").distinct()


def phrase_candidates(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(phrase_id, r1, r2, start): places at which the shifted posting lists of a phrase's terms meet."""
    terms = terms.where(F.col("whole") & (F.col("k") <= TERMS)).select("phrase_id", "word", "off", "need")
    shifted = index.join(_small(terms), "word").select("phrase_id", "need", "r1", "r2", (F.col("pos") - F.col("off")).alias("start"))
    met = shifted.where("start >= 0").groupBy("phrase_id", "need", "r1", "r2", "start").agg(F.count("*").alias("n"))
    return met.where("n = need").select("phrase_id", "r1", "r2", "start")


def proximity_candidates(index: DataFrame, terms: DataFrame, texts: DataFrame, slop: int) -> DataFrame:
    """(phrase_id, r1, r2, start): places that NEAR_MEET looked-up words of a phrase agree on within slop words.

    Places meet in cells of twice the slop on two grids half a cell apart. NEAR_MEET words cannot meet without one of the
    NEAR_ANCHORS rarest, so only the postings of those travel, and the others are looked for in the text, in the two cells
    around them.
    """
    terms, size = terms.where(F.col("len") >= NEAR_LEAST), 2 * slop + 1
    known = terms.groupBy("phrase_id").agg(F.collect_list(F.struct("off", "word")).alias("known")).where(F.size("known") >= NEAR_MEET)
    rarest = terms.where(F.col("k") <= NEAR_ANCHORS).select("phrase_id", "word", "off", "len")
    anchors = index.join(_small(rarest), "word").select("phrase_id", "r1", "r2", "len", (F.col("pos") - F.col("off")).alias("at"))
    # of a text only the words around go on from the join, those of base and after
    words = texts.dropDuplicates(["r1", "r2"]).select("r1", "r2", word_list("text").alias("w"))
    base = F.greatest(F.col("at") - 2 * slop, F.lit(0))
    around = F.slice("w", base + 1, F.col("at") + F.col("len") + 2 * slop - base)
    places = anchors.join(words, ["r1", "r2"]).select("phrase_id", "r1", "r2", "at", base.alias("base"), around.alias("around"))

    def firsts(grid: int) -> Column:
        """For each known word the first place in the anchor's cell that it points to, null if none."""
        shift = grid * (slop + 1)
        low = (F.floor((F.col("at") + shift) / size) * size - shift - F.col("base")).cast("int")

        def first(term: Column) -> Column:
            begin = F.greatest(low + term["off"], F.lit(0))
            found = F.array_position(F.slice("around", begin + 1, F.greatest(low + term["off"] + size - begin, F.lit(0))), term["word"])
            return F.when(found > 0, begin + F.col("base") + found.cast("int") - 1 - term["off"])

        return F.transform("known", first)

    # whether enough of the words are there at all is quickly seen; words that the phrase repeats count as there
    both, again = F.array_intersect("words", "around"), F.size("known") - F.size("words")
    known = known.withColumn("words", F.array_distinct("known.word"))
    places = places.join(_small(known), "phrase_id").where(F.size(both) + again >= NEAR_MEET)
    places = places.select("phrase_id", "r1", "r2", F.explode(F.array(firsts(0), firsts(1))).alias("cell"))
    met = places.where(F.size(F.filter("cell", F.isnotnull)) >= NEAR_MEET)
    return met.select("phrase_id", "r1", "r2", F.array_min("cell").alias("start")).distinct()


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slop: int | None = None) -> DataFrame:
    """All columns of docs, then n_words, n_hit, hits (start, phrase, items), item_ids (sorted as strings) and near_ids.

    near_ids, for a given slop: items of which no phrase occurs but one of NEAR_LEAST words or more matches by proximity:
    NEAR_SHARE of its distinct words stand within slop words of the place that NEAR_MEET of its NEAR_TERMS rarest words
    point to. Without a slop they are not looked for.

    A document word is hit when an occurrence of a phrase covers it. A null text has no words; an item without words has
    no phrase; a null item_id counts as no item, though its phrases hit. Repeated rows get equal results; ties of
    frequency go to the earlier word. Empty tables give no rows or no hits. Clashing columns of docs (n_words, n_hit,
    hits, item_ids, near_ids) are replaced, and its other columns pass through.
    """
    added = ["n_words", "n_hit", "hits", "item_ids", "near_ids"]
    kept = [c for c in docs.columns if c not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = docs.select(row, *row_keys(f"`{id_col}`", f"`{text_col}`"))
    texts = rows.select("r1", "r2", F.col("row")[text_col].alias("text"))
    table = stage(phrases(items, window, item_col, item_text_col).withColumn("phrase_id", F.xxhash64("phrase")), "phrases")
    terms = stage(lookup_terms(table, texts, TERMS if slop is None else NEAR_TERMS), "terms")
    index = stage(postings(texts, terms.where(F.col("k") <= max(TERMS, NEAR_ANCHORS))), "postings")
    found = phrase_candidates(index, terms).withColumn("near", F.lit(False))
    if slop is not None:
        found = found.unionByName(proximity_candidates(index, terms, texts, slop).withColumn("near", F.lit(True)))
    found = found.join(_small(table), "phrase_id")
    found = found.groupBy("r1", "r2").agg(F.collect_list(F.struct("start", "phrase", "items", "near")).alias("c"))
    both = rows.join(found, ["r1", "r2"], "left").withColumn("w", word_list(f"row.`{text_col}`"))
    both = both.withColumn("c", F.coalesce("c", F.array().cast(found.schema["c"].dataType)))
    exact = F.filter("c", lambda c: ~c["near"] & (F.slice(F.col("w"), c["start"] + 1, F.size(c["phrase"])) == c["phrase"]))
    exact = F.transform(exact, lambda c: F.struct(c["start"].alias("start"), c["phrase"].alias("phrase"), c["items"].alias("items")))
    first = lambda c: F.greatest(c["start"] - (slop or 0), F.lit(0))
    there = lambda c: F.array_intersect(c["phrase"], F.slice(F.col("w"), first(c) + 1, F.size(c["phrase"]) + 2 * (slop or 0)))
    close = F.filter("c", lambda c: c["near"] & (F.size(there(c)) >= NEAR_SHARE * F.size(F.array_distinct(c["phrase"]))))
    both = both.select("row", F.size("w").cast("long").alias("n_words"), F.array_sort(exact).alias("hits"), close.alias("close"))
    # the union of the hit spans, in order of their starts
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    fold = F.aggregate("hits", zero, lambda t, h: F.struct((t["n"] + F.greatest(F.lit(0), h["start"] + F.size(h["phrase"]) - F.greatest(h["start"], t["end"]))).alias("n"), F.greatest(t["end"], h["start"] + F.size(h["phrase"])).alias("end")))
    ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda h: F.transform(h["items"], lambda x: x.cast("string"))))))
    out = both.select("row", "n_words", fold["n"].alias("n_hit"), "hits", ids("hits").alias("item_ids"), F.array_except(ids("close"), ids("hits")).alias("near_ids"))
    return out.select("row.*", *added)
