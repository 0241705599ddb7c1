"""Structured Streaming forms of the change log and of track cleaning, their batch twins, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waystone.functions.geo import EARTH_M, haversine_m


def change_log(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that stand after a change log (k, seq, op, payload), and its illegal changes with their problem.

    N inserts and needs a key that isn't there, R replaces and D deletes one that is. Whether a key is there before a change
    follows from the operation before it, so no state is carried; an illegal change takes effect as it says, and is reported.
    """
    by = Window.partitionBy("k").orderBy("seq")
    before = F.lag("op").over(by)
    there = F.coalesce(before != "D", F.lit(False))
    problem = F.when((F.col("op") == "N") & there, "insert-of-existing").when((F.col("op") == "R") & ~there, "replace-of-missing").when((F.col("op") == "D") & ~there, "delete-of-missing")
    last = changes.groupBy("k").agg(F.max_by(F.struct("op", "seq", "payload"), "seq").alias("c"))
    standing = last.where("c.op <> 'D'").select("k", "c.seq", "c.payload")
    return standing, changes.withColumn("problem", problem).where("problem is not null").select("k", "seq", "problem")


def change_log_stream(changes: DataFrame, buckets: int = 1024) -> DataFrame:
    """The same on a stream: an output row (k, seq, op, payload, problem) per change, in seq order of a key within a micro-batch. What
    stands is each key's last row that isn't D.

    Keys are dealt to buckets, and the state of a bucket is the keys that are there, so a task calls Python once a bucket and judges
    its changes together. A bucket's changes of one micro-batch are held at once."""

    def apply(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, none = (np.frombuffer(state.get[0], np.int64), state.get[1]) if state.exists else (np.zeros(0, np.int64), False)
        rows = pd.concat(list(frames)).sort_values(["absent", "k", "seq"], kind="stable", ignore_index=True)
        k, absent, op = rows["k"].to_numpy(), rows["absent"].to_numpy(), rows["op"]
        first = np.append(True, (k[1:] != k[:-1]) | (absent[1:] != absent[:-1]))
        stands = (op != "D").to_numpy()
        there = np.where(first, np.where(absent, none, np.isin(k, held)), np.append(False, stands[:-1]))
        problem = np.select([(op == "N") & there, (op == "R") & ~there, (op == "D") & ~there], ["insert-of-existing", "replace-of-missing", "delete-of-missing"], "")
        last = np.append(first[1:], True)
        known = last & ~absent
        state.update((np.union1d(np.setdiff1d(held, k[known]), k[known & stands]).tobytes(), bool(stands[-1]) if absent[-1] else none))
        yield rows.assign(k=rows["k"].astype("Int64").mask(absent), problem=pd.Series(problem, dtype=object).replace("", None))[["k", "seq", "op", "payload", "problem"]]

    kind = "k long, seq long, op string, payload double, problem string"
    k = F.col("k").cast("long")
    dealt = changes.select(F.pmod(F.xxhash64(k), F.lit(buckets)).alias("_bucket"), F.coalesce(k, F.lit(0).cast("long")).alias("k"), k.isNull().alias("absent"), "seq", "op", "payload")
    return dealt.groupBy("_bucket").applyInPandasWithState(apply, kind, "there binary, none boolean", "append", GroupStateTimeout.NoTimeout)


def expiring_change_log_stream(changes: DataFrame, at: str, until: str, late: str = "1 day") -> DataFrame:
    """change_log_stream() of schedules that end: a key's state goes when the watermark (event time `at`, at most `late` behind) passes
    the latest `until` of its changes, both timestamps. A change to a key after that is judged like one to a key that never was;
    changes behind the watermark are dropped by the engine."""

    def apply(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        there, end = state.get if state.exists else (False, 0)
        if end < state.getCurrentWatermarkMs():  # it has ended, though a change came before its time-out
            there, end = False, 0
        rows = pd.concat(list(frames)).sort_values("seq")
        problems = []
        for op in rows["op"]:
            problems.append("insert-of-existing" if op == "N" and there else "replace-of-missing" if op == "R" and not there else "delete-of-missing" if op == "D" and not there else None)
            there = op != "D"
        last = rows["_until"].max()
        end = max(end, 0 if pd.isna(last) else int(last))
        state.update((there, end))
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(problem=problems)[["k", "seq", "op", "payload", "problem"]]

    kind = "k long, seq long, op string, payload double, problem string"
    timed = changes.withColumn("_until", F.unix_millis(F.col(until).cast("timestamp"))).withWatermark(at, late)
    return timed.groupBy("k").applyInPandasWithState(apply, kind, "there boolean, until long", "append", GroupStateTimeout.EventTimeTimeout)


def cleaned_stream(points: DataFrame, metres: float, gap_s: float, late: str = "10 minutes") -> DataFrame:
    """Points of live tracks (track_id, ts, lon, lat) without those within `metres` of the last kept one, unless gap_s have
    passed: an output row (track_id, ts, lon, lat) per kept point. The state of a track is its last kept point, and goes when
    the watermark is gap_s past it; points behind the watermark are dropped by the engine."""
    import math

    def clean(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts")
        keep = []
        for ts, lon, lat in zip(rows["ts"].astype("int64"), rows["lon"], rows["lat"], strict=True):
            seconds = ts / 1e9
            near = False
            if last is not None and seconds - last[0] <= gap_s:
                h = math.sin(math.radians(lat - last[2]) / 2) ** 2 + math.cos(math.radians(last[2])) * math.cos(math.radians(lat)) * math.sin(math.radians(lon - last[1]) / 2) ** 2
                near = 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h))) <= metres
            keep.append(not near)
            if not near:
                last = (seconds, lon, lat)
        state.update(last)
        state.setTimeoutTimestamp(int(max(last[0] * 1000 + gap_s * 1000, state.getCurrentWatermarkMs() + 1000)))
        yield rows[keep][["track_id", "ts", "lon", "lat"]]

    kind = "track_id long, ts timestamp, lon double, lat double"
    return points.withWatermark("ts", late).groupBy("track_id").applyInPandasWithState(clean, kind, "seconds double, lon double, lat double", "append", GroupStateTimeout.EventTimeTimeout)


def legs_over(points: DataFrame, metres: float) -> DataFrame:
    """The batch rule for neighbours: points farther than `metres` from the point before, and each track's first."""
    by = Window.partitionBy("track_id").orderBy("ts", "pos")
    d = haversine_m(F.lag("lon").over(by), F.lag("lat").over(by), F.col("lon"), F.col("lat"))
    return points.withColumn("d", d).where("d is null or d > " + str(metres)).drop("d")


def window_counts(events: DataFrame, key: str, size: str, slide: str | None = None) -> DataFrame:
    """Events and distinct minutes per key in tumbling or sliding windows of event time; on a stream, after a watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def session_counts(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions of a key: events closer together than the gap."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, writing Parquet and its progress below path, and reads the result back."""
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
