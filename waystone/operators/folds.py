"""Sequential rules per group: rows of a group stream by in order while a small state is carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def folded(df: DataFrame, group: list[str], order: list, start: Callable[[tuple], list], step: Callable[[list, tuple], Iterable[tuple]], columns: str, finish: Callable[[list], Iterable[tuple]] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Rows that step(state, row) gives for each row of a group, in order; start(row) makes the state of a group's first row
    (which step sees too) and finish(state) gives what is left at its end.

    Groups are dealt out by hash and sorted where they land, so a group of any length passes through in batches: nothing of it is
    held but its state, and no step copies what came before. `group` are the first columns of a row; columns (DDL) are those of
    the result; `without` names columns that only sort. A state is a list that step changes in place."""
    schema, k = StructType.fromDDL(columns), len(group)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in df.columns if c not in group]
    dealt = df.select(*group, *rest).repartition(parts, *group).sortWithinPartitions(*group, *order).drop(*without)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cells = list(zip(*rows, strict=True)) if rows else [()] * len(target)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, target, strict=True)], schema=target)

    def run(batches):
        held, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:k] != held:
                    if state is not None and finish:
                        out += finish(state)
                    held, state = row[:k], start(row)
                out += step(state, row)
            yield batch_of(out)
        if state is not None and finish:
            yield batch_of(list(finish(state)))

    return dealt.mapInArrow(run, schema)
