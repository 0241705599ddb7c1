"""State of a change log that ends with what it is about."""

import datetime

from pyspark.sql import functions as F

from waystone.streaming import streams

KIND = "k long, seq long, op string, payload double, at timestamp, runs_to timestamp"


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_state_goes_when_schedules_have_ended(spark, tmp_path):
    batches = [
        [(1, 1, "N", 1.0, day(0), day(5)), (2, 2, "N", 1.0, day(0), day(100)), (3, 3, "N", 1.0, day(0), day(3)), (3, 4, "D", 1.0, day(1), day(3))],
        [(2, 5, "R", 2.0, day(20), day(100))],
        [(1, 6, "R", 2.0, day(40), day(50)), (2, 7, "N", 2.0, day(40), day(100))],
        [(9, 8, "N", 1.0, day(300), day(301))],
        [(9, 9, "R", 1.0, day(400), day(301))],
    ]
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(source))
        for p in source.glob("part-*.parquet"):
            p.rename(source / f"{i}.parquet")
        for p in source.glob("*"):
            if p.name[0] in "._":
                p.unlink()
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source) + "/*.parquet")
    query = streams.expiring_change_log_stream(stream, "at", "runs_to").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["seq"]: r["problem"] for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("problem").isNotNull()).collect()}
    assert got == {6: "replace-of-missing", 7: "insert-of-existing"}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) >= 2 and kept[-1] <= 1
