"""Aggregations over tracks, strokes, calls and evidence: a DataFrame in, one row per group out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def course_parts(parts: DataFrame, course: str, length: str, official: float, under: float, over: float) -> DataFrame:
    """Parts' lengths by course: measured_m, parts, largest_share and verdict against an official length."""
    m = F.col("measured_m")
    c = parts.groupBy(course).agg(F.sum(length).alias("measured_m"), F.max(length).alias("_most"), F.count("*").alias("parts"))
    verdict = F.when(m < official * (1 - under), "too-short").when(m > official * (1 + over), "too-long").otherwise("accepted")
    return c.select(course, "measured_m", "parts", F.try_divide("_most", "measured_m").alias("largest_share"), verdict.alias("verdict"))


def timing_inventory(calls: DataFrame, trip: str, order: list[str], stop: str, passes: Column) -> DataFrame:
    """Per stop: occurrences, passes, calls at a trip's ends, and trips that have it."""
    by = Window.partitionBy(trip)
    c = calls.withColumns({"_p": passes, "_n": F.row_number().over(by.orderBy(*order)), "_last": F.count("*").over(by)})
    ends = (F.col("_n") == 1) | (F.col("_n") == F.col("_last"))
    return c.groupBy(stop).agg(F.count("*").alias("occurrences"), F.count_if("_p").alias("passes"), F.count_if(ends).alias("endpoints"), F.countDistinct(trip).alias("schedules"))


def operator_summary(edges: DataFrame, operator: str, relation: str) -> DataFrame:
    """Per operator: relations, resolved edges (a, b), and edges that are different, in either direction."""
    pair = F.struct(F.least("a", "b"), F.greatest("a", "b"))
    return edges.groupBy(operator).agg(F.countDistinct(relation).alias("relations"), F.count("*").alias("resolved"), F.countDistinct(pair).alias("unique_edges"))


def ink_groups(strokes: DataFrame, group: str, width: Column, flag: Column) -> DataFrame:
    """Per group of strokes (stroke_id, layer, length_mm): count, length, ink (length times pen width), last stroke, layers in
    order, and whether one is flagged. layers holds as many names as there are layers."""
    layers = F.array_join(F.array_sort(F.collect_set("layer")), ",")
    ink = F.sum(F.col("length_mm") * width)
    return strokes.groupBy(group).agg(F.count("*").alias("strokes"), F.sum("length_mm").alias("length_mm"), ink.alias("ink"), F.max("stroke_id").alias("last"), layers.alias("layers"), F.bool_or(flag).alias("flagged"))


def retained(strokes: DataFrame, group: str, size: str, keep: Column) -> DataFrame:
    """Per group: rows kept and left out, the size that is kept and its share (null where there is none)."""
    kept = F.sum(F.when(keep, F.col(size)).otherwise(0.0))
    return strokes.groupBy(group).agg(F.count_if(keep).alias("retained"), F.count_if(~keep).alias("omitted"), kept.alias("retained_mm"), F.try_divide(kept, F.sum(size)).alias("ratio"))


def terrain_density(cells: DataFrame, tile: str = "tile") -> DataFrame:
    """Per tile: distinct whole levels, cells, and the mean of the absolute elevation."""
    return cells.groupBy(tile).agg(F.countDistinct(F.round("z")).alias("levels"), F.count("*").alias("paths"), (F.sum(F.abs("z")) / F.count("*")).alias("density"))


def name_centroid(nodes: DataFrame, name: str) -> DataFrame:
    """Per name the mean place of its nodes (lon, lat), and how many there are."""
    return nodes.groupBy(name).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("n"))


def stop_patterns(calls: DataFrame, trip: str, order: str, stop: str) -> DataFrame:
    """Trips by the pattern of their stops, repeats at once left out: pattern, trips, first_trip. A trip's calls are one array."""
    before = F.lag(stop).over(Window.partitionBy(trip).orderBy(order))
    c = calls.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(stop)))
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(stop).alias("s")))), lambda x: x["s"])
    p = c.groupBy(trip).agg(F.array_join(names, ">").alias("pattern"))
    return p.groupBy("pattern").agg(F.count("*").alias("trips"), F.min(trip).alias("first_trip"))


def cohort_counts(wanted: DataFrame, have: DataFrame, key: str, cohort: str) -> DataFrame:
    """Cohorts (key, cohort, expected) with n, the rows of have (key), and whether they are enough; rows of a key that no cohort
    has are a cohort null."""
    n = have.groupBy(key).agg(F.count("*").alias("_n"))
    met = wanted.join(n, key, "full_outer")
    count = F.coalesce("_n", F.lit(0))
    return met.select(cohort, count.alias("n"), "expected", (count >= F.col("expected")).alias("enough"))


def cubed(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """n for every combination of the keys (column: name in the result) and their subtotals; - stands for all."""
    c = df.cube(*keys).agg(F.count("*").alias("n"))
    return c.select(*[F.coalesce(column, F.lit("-")).alias(name) for column, name in keys.items()], "n")


def path_services(edges: DataFrame, path: str, service: str, edge: str, ineligible: Column) -> DataFrame:
    """Per path and service: edges, different ones, and ineligible ones."""
    return edges.groupBy(path, service).agg(F.count("*").alias("edges"), F.countDistinct(edge).alias("distinct_edges"), F.count_if(ineligible).alias("ineligible"))


def resolution(strokes: DataFrame, layer: str, pen: str, width: Column, scale: float) -> DataFrame:
    """Per layer: the widest pen, the shortest stroke, the longest on the ground (page millimetres times scale in metres), and
    the pens in order."""
    pens = F.array_join(F.array_sort(F.collect_set(pen)), ",")
    return strokes.groupBy(layer).agg(F.max(width).alias("nib"), F.min("length_mm").alias("least_mm"), (F.max("length_mm") * scale).alias("ground_m"), pens.alias("pens"))


def coverage_gaps(points: DataFrame, subject: Column, west: Column, east: Column) -> DataFrame:
    """Per subject its points' extent in longitude and whether it leaves a gap to the wanted one; west and east are columns of
    `subject`."""
    box = points.groupBy(subject.alias("subject")).agg(F.min("lon").alias("west"), F.max("lon").alias("east"))
    return box.select("subject", "west", "east", (F.col("west") > west).alias("gap_west"), (F.col("east") < east).alias("gap_east"))


def gates(rows: DataFrame, artifact: str, order: str, failed: Column, name: Column) -> DataFrame:
    """Per artifact: gates, failed ones, and their names in order."""
    named = F.when(failed, F.struct(F.col(order).alias("o"), name.alias("name")))
    failures = F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["name"]), ";")
    return rows.groupBy(artifact).agg(F.count("*").alias("gates"), F.count_if(failed).alias("failed"), failures.alias("failures"))


def source_ledger(strokes: DataFrame, layer: str, ref: str, emitted: Column, explained: Column) -> DataFrame:
    """Per layer its source references: visible, emitted (one of their strokes is), and the others, explained or not. explained is
    a column of layer and ref."""
    each = strokes.groupBy(layer, ref).agg(F.bool_or(emitted).alias("_out"))
    out = F.col("_out")
    return each.groupBy(layer).agg(F.count("*").alias("visible"), F.count_if(out).alias("emitted"), F.count_if(~out & explained).alias("explained"), F.count_if(~out & ~explained).alias("unexplained"))


def by_state(rows: DataFrame, key: Column, state: Column, states: dict[str, str]) -> DataFrame:
    """Per key the rows in each of some states (value: name in the result)."""
    marked = rows.select(key, state.alias("_s"))
    name = marked.columns[0]
    return marked.groupBy(name).agg(*[F.count_if(F.col("_s") == value).alias(label) for value, label in states.items()])


def elevation_extent(points: DataFrame, track: str = "track_id") -> DataFrame:
    """Per track the least and greatest elevation, whether there is any, and whether all points have one."""
    return points.groupBy(track).agg(F.min("ele").alias("least_ele"), F.max("ele").alias("most_ele"), F.bool_or(F.col("ele").isNotNull()).alias("any_ele"), F.bool_and(F.col("ele").isNotNull()).alias("complete"))


def held_events(events: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Events with hold (the names of the reasons that hold, in order) and renderable, where there is none."""
    hold = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in reasons.items()]))
    return events.withColumn("_h", hold).withColumns({"renderable": F.size("_h") == 0, "hold": F.array_join("_h", ";")}).drop("_h")


def bucketed(df: DataFrame, bucket: Column, size: str) -> DataFrame:
    """Rows and their size by a bucket that the caller states."""
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("strokes"), F.sum(size).alias("mm"))


def inked(df: DataFrame, key: str, length: str, width: Column) -> DataFrame:
    """Ink of each row by a width that the caller states."""
    return df.select(key, (F.col(length) * width).alias("ink"))


def generated(df: DataFrame, key: Column, most: Column, step: int) -> DataFrame:
    """A row of each key at 0, step, .. below `most`; none where that isn't above 0."""
    steps = F.when(most > 0, F.sequence(F.lit(0).cast("long"), most.cast("long") - 1, F.lit(step).cast("long")))
    return df.select(key, F.explode(steps).alias("at"))
