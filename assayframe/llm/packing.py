"""Best-fit packing planned on the histogram of piece lengths.

The plan needs only how many pieces have each length, at most ``size`` numbers whatever the corpus, so it is made on the
driver. Documents then take planned slots by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import text_encoder
from .spark_io import stage

#: Pieces of one length that are ranked in one part.
PART = 50_000


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: rows (length, first rank, end rank, first sequence, slots in each, offset).

    Sequences filled alike form one group with a count, so the work follows the number of lengths and not of pieces.
    Pieces of a length with ranks [first, end) fill sequences from the first on, ``slots`` in each, from the offset on.
    """
    open_at: dict[int, list] = {}  # room left -> groups of sequences, each [count, [(length, how many)]]
    rooms: list[int] = []
    done = []

    def put(room: int, group: list) -> None:
        if not room:
            done.append(group)
            return
        if room not in open_at:
            open_at[room] = []
            bisect.insort(rooms, room)
        open_at[room].append(group)

    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    put(size - each * length, [full, [(length, each)]])
                if rest:
                    put(size - rest * length, [1, [(length, rest)]])
                break
            room = rooms[at]
            groups = open_at[room]
            count, filled = groups.pop()
            if not groups:
                del open_at[room]
                rooms.pop(at)
            each = room // length  # the fullest sequence that still fits stays the fullest
            full, rest = divmod(left, each)
            take = min(full, count)
            if take:
                put(room - each * length, [take, [*filled, (length, each)]])
                left -= take * each
            if count > take:
                if left and take == full and rest:
                    put(room - rest * length, [1, [*filled, (length, rest)]])
                    left -= rest
                    take += 1
                if count > take:
                    put(room, [count - take, filled])
    done += [g for r in rooms for g in open_at[r]]
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for count, filled in done:
        offset = 0
        for length, each in filled:
            first = rank.get(length, 0)
            out.append((length, first, first + each * count, sequence, each, offset))
            rank[length] = first + each * count
            offset += each * length
        sequence += count
    return out


def piece_table(docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", end_id: int | None = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with end_id, cut only where longer than size."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = [] if end_id is None else [end_id]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        for batch in batches:
            for i, j, ids, bounds in encoder.batches(batch.column(1)):
                if end:
                    ids = np.insert(ids, bounds[1:], end[0])
                    bounds = bounds + np.arange(len(bounds))
                n = np.diff(bounds)
                pieces = -(-n // size)
                doc = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * size
                length = np.minimum(n[doc] - start, size)
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                at = (bounds[:-1][doc] + start).tolist()
                crc = np.array([zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at, length.tolist())], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(encode, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def place(pieces: DataFrame, size: int) -> DataFrame:
    """sequence_id and offset for a stored table of pieces.

    Only the histogram reaches the driver. The plan has some thousand rows at most, a bound that size sets and not the
    corpus, and is broadcast. Pieces of one length, however many, are ranked in parts of about PART.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = spark.createDataFrame([(k, -(-n // PART)) for k, n in histogram.items()], "length bigint, parts bigint")
    keyed = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts"))).drop("parts")
    counts = keyed.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    ranked = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(offsets, ["length", "part"]).withColumn("rank", F.col("skip") + F.col("nth"))
    rows = plan(histogram, size)
    # the slots of a length as one row, so that the join has one partner for each piece
    slots: dict[int, list] = {}
    for length, *slot in rows:
        slots.setdefault(length, []).append(tuple(slot))
    schema = "length bigint, slots array<struct<first:bigint,stop:bigint,sequence:bigint,each:bigint,off:bigint>>"
    table = spark.createDataFrame([(k, v) for k, v in slots.items()], schema)
    joined = ranked.join(F.broadcast(table), "length")
    slot = F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["stop"]))[0]
    joined = joined.withColumn("slot", slot).withColumn("k", F.col("rank") - F.col("slot.first"))
    sequence = F.col("slot.sequence") + F.floor(F.col("k") / F.col("slot.each"))
    offset = F.col("slot.off") + F.col("k") % F.col("slot.each") * F.col("length")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack(docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", end_id: int | None = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone (without an end id it has no piece). Repeated rows are packed as often as
    they come; ties of length go by a hash of doc_id and piece. An empty table gives no rows.
    """
    pieces = stage(piece_table(docs, tokenizer=tokenizer, end_id=end_id, size=size, id_col=id_col, text_col=text_col), "pieces")
    return place(pieces, size)
