"""Numbering of lines over splits, the order of timetable records, and rings of very many edges."""

import math
import random
import time

from pyspark.sql import functions as F

from waystone.operators import coverage
from waystone.sources import readers


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for name in ("a.txt", "b.txt", "c.txt"):
        lines = ["" if rng.random() < 0.1 else f"{name} {k} é" + "x" * rng.randrange(40) for k in range(3000 if name != "c.txt" else 1)]
        (tmp_path / name).write_bytes(("\r\n" if name == "b.txt" else "\n").join(lines).encode())
        want |= {(name, k): v for k, v in enumerate(lines) if v}
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        rows = readers.numbered(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got == want


def test_order_of_timetable_records(spark):
    files = {
        1: ["HD", "TI", "BS", "BX", "LO", "LI", "CR", "LI", "LT", "BS", "LO", "LT", "ZZ"],
        2: ["BS", "LO", "LI", "BS", "LO", "LT"],
        3: ["HD", "BS", "LO", "BX", "QQ", "LT", "HD", "ZZ", "BS"],
        4: ["HD", "BS", "LO", "LI"],
        5: ["HD", "ZZ"],
    }
    rows = [(f, 2 * k, v + " rest") for f, kinds in files.items() for k, v in enumerate(kinds)]
    for block in (1 << 16, 3):
        got = sorted(map(tuple, readers.cif_rejects(spark.createDataFrame(rows, "file int, line long, value string"), block).collect()))
        assert got == sorted([
            (2, 0, "no-header"), (2, 6, "unfinished"), (2, 10, "no-trailer"),
            (3, 6, "misplaced"), (3, 8, "unknown-record"), (3, 10, "misplaced"), (3, 12, "misplaced-header"), (3, 16, "after-trailer"), (3, 16, "no-trailer"),
            (4, 6, "no-trailer"), (4, 6, "unfinished"),
        ])


def test_a_ring_of_very_many_edges(spark):
    """A shore of 100,000 edges and 200,000 points: a point meets its strip's edges only."""
    n, points = 100_000, 200_000
    radius = lambda k: F.when(k % 2 == 0, 10.0).otherwise(9.9999)
    k = F.col("id")
    at = lambda k: (radius(k) * F.cos(k * (2 * math.pi / n)), radius(k) * F.sin(k * (2 * math.pi / n)))
    (x0, y0), (x1, y1) = at(k), at((k + 1) % n)
    ring = spark.range(n).select(F.lit(1).alias("ring_id"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    spot = spark.range(points).select(F.col("id").alias("p"), F.lit(1).alias("ring_id"), (F.rand(1) * 24 - 12).alias("x"), (F.rand(2) * 24 - 12).alias("y"))
    began = time.time()
    r = F.hypot("x", "y")
    got = coverage.inside_rings(spot, ring, ["p"]).where((r < 9.99) != F.col("inside")).where((r < 9.99) | (r > 10.01))
    assert got.count() == 0 and time.time() - began < 150
