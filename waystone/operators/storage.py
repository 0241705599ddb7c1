"""Tables that loops and repeated reads rest on, kept in the folder that all executors share."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Where tables go if spark.checkpoint.dir is unset and there is no other machine to share them with.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session of one machine gets one of its own, and any other an
    error, as its machines share no temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
    return FALLBACK_DIR


def settled(df: DataFrame) -> DataFrame:
    """df, computed once as a Parquet table in the shared folder and read from there: a loop's rounds start from it afresh, and
    what is lost later is read again. (A checkpoint would carry the optimizer's constraints on, which double every round.)"""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables that settled() made and that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def pinned(df: DataFrame) -> DataFrame:
    """df, computed once and checkpointed in the shared folder: its partitions too stay as they are, whatever is lost later."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
