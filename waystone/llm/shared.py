"""Shared-folder tables and small column helpers of the llm operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waystone.llm import pieces

#: Where tables go if spark.checkpoint.dir is unset and there is no other machine to share them with.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset, a session of one machine gets one of its
    own, and any other an error, as its machines share no temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.conf.set("spark.checkpoint.dir", FALLBACK_DIR)
        found = FALLBACK_DIR
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing.

    The folder of each call is new, so a repeated job never meets an older one's files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def spent(*tables: DataFrame) -> None:
    """Removes tables that written() made and that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def appended(docs: DataFrame, make: Callable, **columns: str) -> DataFrame:
    """docs with its columns called c0, c1, .. by position, and after them the columns that make(texts of a batch) gives.

    Positions instead of names: docs may have any names, dotted ones and those of the new columns too. After a choice of rows
    `.select` or `.drop` of the new columns and `.toDF(*docs.columns)` give docs' own columns back.
    """
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = StructType(list(plain.schema.fields))
    for name, kind in columns.items():
        schema = schema.add(name, kind)

    def run(batches):
        pieces.forget()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch.column(at))], [*batch.schema.names, *columns])

    return plain.mapInArrow(run, schema)


def either_case(word: str) -> str:
    """A pattern for word with its ASCII letters in either case, alike in every regex engine."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in word)


#: A filter of keys: BLOCKS rows of WORDS 64-bit words, and the bits that a key sets in its block. 8 MB, whatever the number of keys.
BLOCKS, WORDS, HASHES = 2048, 512, 4


def _bits(keys: list[Column]) -> list[Column]:
    return [F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(WORDS * 64)) for i in range(1, HASHES + 1)]


def key_filter(keyed: DataFrame) -> DataFrame:
    """A blocked Bloom filter of keyed's rows: block and words, for maybe_in(). Its size is fixed, so it may be broadcast."""
    keys = [F.col(f"`{c}`") for c in keyed.columns]
    block = F.pmod(F.xxhash64(*keys), F.lit(BLOCKS)).cast("int").alias("block")
    bits = keyed.select(block, F.explode(F.array(*_bits(keys))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))
    words = bits.groupBy("block", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))
    held = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long")))
    return words.groupBy("block").agg(held.alias("held")).select("block", filled.alias("words"))


def maybe_in(rows: DataFrame, keys: list[Column], held: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column `name`: false only where the keys aren't among those of the filter. A filter of very many
    keys says true more often, never false wrongly: it saves an exchange of rows, and nothing else rests on it."""
    words = F.broadcast(held.withColumnsRenamed({"block": "_filter_block", "words": "_filter_words"}))
    met = rows.join(words, F.pmod(F.xxhash64(*keys), F.lit(BLOCKS)).cast("int") == F.col("_filter_block"), "left")
    of = lambda bit: F.getbit(F.get("_filter_words", F.floor(bit / 64).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1
    every = reduce(lambda a, b: a & b, map(of, _bits(keys)))
    return met.withColumn(name, F.coalesce(every, F.lit(False))).drop("_filter_block", "_filter_words")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def classes(links: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b): rows (id, class_id), class_id the least id of the component.

    Each round takes the least label among neighbours and then jumps to the label's own label, until nothing changes;
    every round is a table in the shared folder. Hubs are joined, never gathered, so adaptive execution can split them.
    """
    spark = links.sparkSession
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    last = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("class_id")), "labels")
    while True:
        labels = last.select("id", "class_id")
        near = both.join(labels.select(F.col("id").alias("b"), F.col("class_id").alias("l")), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        hooked = labels.join(near, "id", "left").select("id", F.col("class_id").alias("was"), F.least("class_id", "l").alias("class_id"))
        up = labels.select(F.col("id").alias("class_id"), F.col("class_id").alias("root"))
        after = written(hooked.join(up, "class_id", "left").select("id", "was", F.least(F.col("class_id"), F.col("root")).alias("class_id")), "labels")
        spent(last)
        if after.where("was <> class_id").isEmpty():
            spent(both)
            return after.select("id", "class_id")
        last = after
