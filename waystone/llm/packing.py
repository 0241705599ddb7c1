"""Best-fit packing planned on the histogram of lengths; documents take the planned slots by their rank within a length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waystone.llm import pieces
from waystone.llm.shared import partitions, written

CAPACITY = 1024
END_ID = 2
PLAN = "length int, first long, last long, sequence long, each long, used long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each text's ids with the end id, cut into pieces of at most capacity: doc_id, piece, start, length, ids_crc32.

    Only longer documents are cut; then every piece but the first has exactly capacity ids. Null texts count as empty.
    """

    def cut(batches):
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for a, b, texts in pieces.text_blocks(batch.column("text")):
                ids, counts = pieces.encode_block(tokenizer, texts)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                ends = np.cumsum(counts + 1)
                for key, e, n in zip(keys[a:b], ends.tolist(), (counts + 1).tolist(), strict=True):
                    s = 0
                    for k in range(-(-n // capacity)):
                        size = (n - 1) % capacity + 1 if k == 0 else capacity
                        rows.append((key, k, s, size, zlib.crc32(ids[e - n + s : e - n + s + size])))
                        s += size
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, first, last, sequence, each, used): pieces of that length with ranks
    first..last fill sequences from `sequence` on, `each` to a sequence, from offset `used` in it.

    The work depends on how many lengths there are, not on how many documents. A length ends with at most three new runs of
    sequences; a run that a length fills up keeps less than half of its room, so it comes up again log2(capacity) times at
    most: there are no more than 3 * lengths * (log2(capacity) + 2) rows, whatever the corpus."""
    rows, opened = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # free ids -> runs (sequence, how many) of sequences with that room
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            free = min((r for r in room if r >= length), default=0)
            if free:
                start, n = room[free].pop()
                if not room[free]:
                    del room[free]
            else:
                free, n, start = capacity, -(-left // (capacity // length)), opened
                opened += n
            each = free // length
            full, part = min(n, left // each), 0
            if full < n and left - full * each:
                part = left - full * each
            if full:
                rows.append((length, rank, rank + full * each - 1, start, each, capacity - free))
                rank += full * each
                room.setdefault(free - each * length, []).append((start, full))
            if part:
                rows.append((length, rank, rank + part - 1, start + full, part, capacity - free))
                rank += part
                room.setdefault(free - part * length, []).append((start + full, 1))
            if n - full - (part > 0) > 0:
                room.setdefault(free, []).append((start + full + (part > 0), n - full - (part > 0)))
            left = histogram[length] - rank
            room.pop(0, None)
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, and whatever else they carry).

    Best-fit runs on the histogram, which has at most `capacity` rows. A piece's rank within its length is the number of
    equal lengths in lower buckets plus its place in its own bucket, so a length that half of the pieces share is still
    ranked by many tasks. Equal rows get different slots. An empty input gives an empty result.
    """
    spark = cut.sparkSession
    count = 4 * partitions(spark)
    cut = written(cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(count))), "pieces")
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = counts.select("length", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = cut.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))
    slots = spark.createDataFrame(plan(histogram, capacity), PLAN)  # bounded by the number of lengths: see plan()
    met = ranked.join(F.broadcast(slots.withColumnRenamed("length", "l")), (F.col("length") == F.col("l")) & F.col("rank").between(F.col("first"), F.col("last")))
    at = F.col("rank") - F.col("first")
    return met.withColumns({"sequence_id": F.col("sequence") + F.floor(at / F.col("each")), "offset": F.col("used") + at % F.col("each") * F.col("length")}).drop("bucket", "before", "own", "rank", "l", "first", "last", "sequence", "each", "used")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity)
