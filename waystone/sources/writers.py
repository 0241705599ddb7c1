"""Sinks: canonical JSON lines, checksum lists and Markdown tables, as text that equal inputs give alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_json(df: DataFrame, order: list[str]) -> DataFrame:
    """One compact JSON line per row, keys sorted, nulls kept, in the order given."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return df.orderBy(*order).select(line.alias("value"))


def checksum_lines(files: DataFrame, root: str) -> DataFrame:
    """`<sha>  <path below root>` of artifacts (path, sha), by path."""
    below = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(below.alias("p"), "sha").orderBy("p").select(F.concat("sha", F.lit("  "), "p").alias("value"))


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """A row of a Markdown table per row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
