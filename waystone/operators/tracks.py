"""Tracks as vertex rows: chainage, runs, cleaning, stations, resampling. Points of a track are ordered by seg and pos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone.functions.geo import haversine_m, metres
from waystone.operators.folds import folded


def segmented(points: DataFrame, gap_s: float, track: str = "track_id") -> DataFrame:
    """Adds seg (from 0): a new segment begins after a gap of more than gap_s. points: track, ts, pos."""
    order = Window.partitionBy(track).orderBy("pos")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    return points.withColumn("seg", F.sum(F.when(gap > int(gap_s * 1_000_000), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def chainage(points: DataFrame, track: str = "track_id") -> DataFrame:
    """Adds leg_m and cum_m: distances inside a segment add up over the whole track, a segment break adds none."""
    by = Window.partitionBy(track).orderBy("pos")
    same = F.lag("seg").over(by) == F.col("seg")
    leg = F.when(same, haversine_m(F.lag("lon").over(by), F.lag("lat").over(by), F.col("lon"), F.col("lat"))).otherwise(0.0)
    return points.withColumn("leg_m", leg).withColumn("cum_m", F.sum("leg_m").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def islands(df: DataFrame, starts: Column, partition: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the number (from 0 or 1) of the run a row is in; starts says where a run begins."""
    by = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def profile_runs(points: DataFrame, track: str = "track_id") -> DataFrame:
    """Runs of points with elevation: a segment's start and a missing elevation end a run. track, run, first, last, points."""
    by = Window.partitionBy(track).orderBy("pos")
    breaks = F.col("ele").isNull() | F.coalesce(F.lag("seg").over(by) != F.col("seg"), F.lit(True)) | F.lag("ele").over(by).isNull()
    marked = points.withColumn("_b", breaks)
    return islands(marked, F.col("_b"), [track], ["pos"], "_run").where("ele is not null").groupBy(track, "_run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("points"), F.min("ele").alias("least_ele"), F.max("ele").alias("most_ele")).drop("_run")


def verification(points: DataFrame, official_m: Column, under: float, over: float, least_run: float = 0.80, track: str = "track_id", official: str | None = None) -> DataFrame:
    """Measured length of a course against its official one: signed relative error within -under and +over, largest segment
    at least least_run of the whole, and the reasons where it isn't accepted. points: with leg_m and seg. official: a column
    of points that holds the official length, instead of official_m."""
    held = F.max(official) if official else F.lit(None).cast("double")
    parts = points.groupBy(track, "seg").agg(F.sum("leg_m").alias("m"), held.alias("o"))
    course = parts.groupBy(track).agg(F.sum("m").alias("measured_m"), F.max("m").alias("largest_m"), F.count("*").alias("parts"), F.max("o").alias("official_m"))
    course = course if official else course.withColumn("official_m", official_m)
    error = F.try_divide(F.col("measured_m") - F.col("official_m"), F.col("official_m"))
    share = F.try_divide(F.col("largest_m"), F.col("measured_m"))
    reasons = F.array_compact(F.array(F.when(F.col("measured_m") <= 0, "no-length"), F.when(error < -under, "too-short"), F.when(error > over, "too-long"), F.when(share < least_run, "fragmented")))
    return course.withColumns({"relative_error": error, "largest_share": share, "reasons": reasons}).withColumn("accepted", F.size("reasons") == 0)


def deduplicated(points: DataFrame, tolerance_m: float, track: str = "track_id", merged: tuple[str, ...] = (), either: tuple[str, ...] = ()) -> DataFrame:
    """points with separation_m: null for a kept point, else how far it lay from the last kept one of its segment (within the
    tolerance). A kept point takes over the later values of `merged` columns from those that it stands for, where they have one,
    and of `either` columns whether any of them says so. track, seg, pos, lon, lat, merged, either, separation_m."""
    names = [track, "seg", "pos", "lon", "lat", *merged, *either]
    flat = points.select(track, "seg", F.col("pos").cast("bigint").alias("pos"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), *merged, *either)
    m = 5 + len(merged)

    def step(state, row):
        if state[0] is None:
            state[0] = list(row)
            return ()
        kept = state[0]
        away = metres(kept[3], kept[4], row[3], row[4])
        if away > tolerance_m + 1e-9:
            state[0] = list(row)
            return ((*kept, None),)
        for c in range(5, m):
            kept[c] = kept[c] if row[c] is None else row[c]
        for c in range(m, len(row)):
            kept[c] = bool(kept[c] or row[c])
        return ((*row, away),)

    ddl = ", ".join(f"`{n}` {flat.schema[n].dataType.simpleString()}" for n in names)
    return folded(flat, [track, "seg"], ["pos"], lambda row: [None], step, f"{ddl}, separation_m double", lambda state: [(*state[0], None)])


def without_repeats(points: DataFrame, tolerance_m: float, track: str = "track_id", merged: tuple[str, ...] = (), either: tuple[str, ...] = ()) -> DataFrame:
    """The points that deduplicated() keeps: track, seg, pos, lon, lat, merged, either."""
    return deduplicated(points, tolerance_m, track, merged, either).where("separation_m is null").drop("separation_m")


def spikes(points: DataFrame, least_m: float, ratio: float, median_times: float, track: str = "track_id", speed_m_s: float | None = None, preserved: str | None = None) -> DataFrame:
    """Isolated outliers: inner points of a segment whose legs from the last kept point and to the next one are both long (least_m,
    and median_times the segment's median leg) and whose detour is `ratio` times the way past them. track, pos, detour_m.

    What is kept depends on what was kept before. Segments of fewer than four points have none. speed_m_s: where the times of
    points (ts) give the speed of a leg, one leg must be faster than this as well. preserved: a column of points that stay."""
    by = Window.partitionBy(track, "seg").orderBy("pos")
    leg = haversine_m(F.lag("lon").over(by), F.lag("lat").over(by), F.col("lon"), F.col("lat"))
    stay = F.coalesce(F.col(preserved), F.lit(False)) if preserved else F.lit(False)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 if speed_m_s is not None else F.lit(None).cast("double")
    held = points.select(track, "seg", "pos", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), at.alias("t"), stay.alias("stay"), leg.alias("leg"))
    gates = held.groupBy(track, "seg").agg(F.count("*").alias("n"), F.coalesce(F.percentile(F.when(F.col("leg") > 1e-6, F.col("leg")), F.lit(0.5)), F.lit(0.0)).alias("typical")).where("n >= 4")
    ahead = {f"{c}2": F.lead(c).over(by) for c in ("lon", "lat", "t")}
    rows = held.withColumns(ahead).join(gates, [track, "seg"]).select(track, "seg", F.col("pos").cast("bigint").alias("pos"), "lon", "lat", "t", "stay", "lon2", "lat2", "t2", F.greatest(F.lit(float(least_m)), F.col("typical") * median_times).alias("gate"))

    def step(state, row):
        _, _, pos, lon, lat, t, stays, lon2, lat2, t2, gate = row
        if state[0] is not None and lon2 is not None and not stays:
            x, y, before = state[0]
            a, b, past = metres(x, y, lon, lat), metres(lon, lat, lon2, lat2), metres(x, y, lon2, lat2)
            speeds = [m / (q - p) for m, p, q in ((a, before, t), (b, t, t2)) if p is not None and q is not None and q > p]
            fast = not speeds or max(speeds) > speed_m_s
            if a >= gate and b >= gate and (a + b) / max(past, 0.01) >= ratio and fast:
                return ((row[0], pos, a + b),)
        state[0] = (lon, lat, t)
        return ()

    return folded(rows, [track, "seg"], ["pos"], lambda row: [None], step, f"`{track}` {points.schema[track].dataType.simpleString()}, pos bigint, detour_m double")


def legs_of(points: DataFrame, track: str = "track_id") -> DataFrame:
    """Segments of a track with chainage at both ends: d0 <= d < d1 finds the leg a station is on. Needs cum_m and seg."""
    by = Window.partitionBy(track).orderBy("pos")
    cols = {f"{c}1": F.lead(c).over(by) for c in ("lon", "lat", "ele", "cum_m", "seg")}
    legs = points.withColumns(cols)
    return legs.where((F.col("seg") == F.col("seg1")) & (F.col("cum_m1") > F.col("cum_m"))).select(track, "pos", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.col("ele").alias("ele0"), F.col("cum_m").alias("d0"), "lon1", "lat1", "ele1", F.col("cum_m1").alias("d1"))


def stations(legs: DataFrame, wanted: DataFrame, track: str = "track_id") -> DataFrame:
    """Where requested chainages (track, d) lie: lon, lat, elevation and its status.

    A leg holds the stations of (d0, d1], and the first leg its start too, so that a station on a vertex is found once.
    Elevation is observed on a vertex, interpolated between two known ones, else unavailable. Legs and stations of a track
    are sorted together, and a station takes the last leg that began before it: no station meets another leg."""
    leg = F.struct("lon0", "lat0", "ele0", "d0", "lon1", "lat1", "ele1", "d1")
    marks = legs.select(track, F.col("d0").alias("d"), F.lit(1).alias("_o"), leg.alias("leg"))
    asked = wanted.select(track, F.col("d").cast("double").alias("d"), F.lit(0).alias("_o"), F.lit(None).cast(marks.schema["leg"].dataType).alias("leg"))
    by = Window.partitionBy(track).orderBy("d", "_o")
    before = F.last("leg", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("leg", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    met = marks.unionByName(asked).withColumn("_l", F.coalesce(before, first)).where("_o = 0").where((F.col("d") >= F.col("_l.d0")) & (F.col("d") <= F.col("_l.d1")))
    f = (F.col("d") - F.col("_l.d0")) / (F.col("_l.d1") - F.col("_l.d0"))
    mix = lambda c: F.col(f"_l.{c}0") + f * (F.col(f"_l.{c}1") - F.col(f"_l.{c}0"))
    ele = F.when(f == 1, F.col("_l.ele1")).when(f == 0, F.col("_l.ele0")).otherwise(mix("ele"))
    status = F.when(ele.isNull(), "unavailable").when((f == 0) | (f == 1), "observed").otherwise("interpolated")
    return met.select(track, "d", mix("lon").alias("lon"), mix("lat").alias("lat"), ele.alias("ele"), status.alias("status"))


def every_metres(legs: DataFrame, step_m: float, track: str = "track_id") -> DataFrame:
    """Requested chainages at a fixed step from each track's start to its end: each leg emits those it holds."""
    n0, n1 = F.floor(F.col("d0") / step_m) + 1, F.floor(F.col("d1") / step_m)
    return legs.where(n1 >= n0).select(track, F.explode(F.transform(F.sequence(n0, n1), lambda i: i * step_m)).alias("d"))


def resampled(legs: DataFrame, step_m: float, track: str = "track_id") -> DataFrame:
    """Points (track, d, lon, lat) at a fixed step along each track: a leg interpolates those it holds, nothing is joined."""
    n0, n1 = F.floor(F.col("d0") / step_m) + 1, F.floor(F.col("d1") / step_m)
    at = legs.where(n1 >= n0).select("*", F.explode(F.transform(F.sequence(n0, n1), lambda i: i * step_m)).alias("d"))
    f = (F.col("d") - F.col("d0")) / (F.col("d1") - F.col("d0"))
    mix = lambda c: (F.col(f"{c}0") + f * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(c)
    return at.select(track, "d", mix("lon"), mix("lat"))


def turn_stations(laps: DataFrame, step_m: float = 20.0, window_m: float = 60.0, least_degrees: float = 14.0, apart_m: float = 95.0, most: int = 30) -> DataFrame:
    """Stations of strong curvature on closed laps (lap, pos, x, y in metres; the last point joins the first): lap, d, turn.

    A lap is sampled at equal steps of about step_m (16 at least), and the heading change over window_m to both sides is
    taken round the lap. Of changes of least_degrees the strongest are kept first, none nearer than apart_m round the lap
    to a kept one, `most` at most. Laps under 300 m have none. One lap's candidates are folded as one array."""
    by = Window.partitionBy("lap").orderBy("pos")
    whole = Window.partitionBy("lap")
    first = F.first(F.struct("x", "y")).over(by)
    legs = laps.select("lap", "pos", F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce(F.lead("x").over(by), first["x"]).alias("x1"), F.coalesce(F.lead("y").over(by), first["y"]).alias("y1"))
    legs = legs.withColumn("m", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).where("m > 0")
    legs = legs.withColumns({"d1": F.sum("m").over(by.rowsBetween(Window.unboundedPreceding, 0)), "length": F.sum("m").over(whole)}).withColumn("d0", F.col("d1") - F.col("m"))
    legs = legs.where("length >= 300").withColumn("count", F.greatest(F.lit(16), F.ceil(F.col("length") / step_m))).withColumn("step", F.col("length") / F.col("count"))
    n0, n1 = F.ceil(F.col("d0") / F.col("step") - 1e-9), F.least(F.ceil(F.col("d1") / F.col("step") - 1e-9) - 1, F.col("count") - 1)
    at = legs.where(n1 >= n0).select("*", F.explode(F.sequence(n0, n1)).alias("i"))
    f = (F.col("i") * F.col("step") - F.col("d0")) / F.col("m")
    points = at.select("lap", "i", "count", "step", "length", (F.col("x0") + f * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + f * (F.col("y1") - F.col("y0"))).alias("y"))
    offset = F.greatest(F.lit(2), F.round(window_m / F.col("step")).cast("int")) % F.col("count")
    points = points.withColumn("offset", offset)
    # a lap's first and last points stand once more behind and before it, so that the sorted lap itself holds a point's neighbours
    beside = F.array(F.col("i"), F.when(F.col("i") < F.col("offset"), F.col("i") + F.col("count")), F.when(F.col("i") >= F.col("count") - F.col("offset"), F.col("i") - F.col("count")))
    ringed = points.withColumn("i", F.explode(F.array_compact(beside)))
    least = min(300 / 16, step_m * 300 / (300 + step_m))  # no step of a lap of 300 m or more is shorter
    offsets = range(0, max(2, round(window_m / least)) + 1)
    round_lap = Window.partitionBy("lap").orderBy("i")
    pick = lambda f: F.coalesce(*[F.when(F.col("offset") == k, f(F.struct("x", "y"), k).over(round_lap)) for k in offsets])
    met = ringed.withColumns({"p": pick(F.lag), "q": pick(F.lead)}).where((F.col("i") >= 0) & (F.col("i") < F.col("count")))
    turn = F.atan2(F.col("q.y") - F.col("y"), F.col("q.x") - F.col("x")) - F.atan2(F.col("y") - F.col("p.y"), F.col("x") - F.col("p.x"))
    bent = met.select("lap", "length", (F.col("i") * F.col("step")).alias("d"), F.degrees(F.abs(F.atan2(F.sin(turn), F.cos(turn)))).alias("turn")).where(F.col("turn") >= least_degrees)
    packed = bent.groupBy("lap", "length").agg(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("n"), "d"))).alias("items"))

    def apart(a, b):
        direct = F.abs(a["d"] - b["d"])
        return F.least(direct, F.greatest(F.lit(0.0), F.col("length") - direct))

    keep = lambda kept, x: F.when((F.size(kept) < most) & ~F.exists(kept, lambda y: apart(x, y) < apart_m), F.concat(kept, F.array(x))).otherwise(kept)
    kept = packed.select("lap", F.explode(F.aggregate("items", F.array().cast("array<struct<n:double,d:double>>"), keep)).alias("s"))
    return kept.select("lap", "s.d", (-F.col("s.n")).alias("turn"))


def collapsed_stops(calls: DataFrame, trip: str, order: list[str], stop: str) -> DataFrame:
    """Calls without those at the same stop as the call before."""
    before = F.lag(stop).over(Window.partitionBy(trip).orderBy(*order))
    return calls.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(stop))).drop("_b")


def transitions(calls: DataFrame, trip: str, order: list[str], stop: str, example: str) -> DataFrame:
    """How often a stop is followed by another within a trip: origin, destination, n and the least example."""
    before = F.lag(stop).over(Window.partitionBy(trip).orderBy(*order))
    pairs = calls.select(before.alias("origin"), F.col(stop).alias("destination"), F.col(example).alias("example")).where("origin is not null")
    return pairs.groupBy("origin", "destination").agg(F.count("*").alias("n"), F.min("example").alias("example"))


def discontinuities(members: DataFrame, group: str, ends: Column) -> DataFrame:
    """Members of an ordered group (group, pos) none of whose ends (an array) is one of the next member's: the breaks."""
    following = F.lead("_e").over(Window.partitionBy(group).orderBy("pos"))
    return members.withColumn("_e", ends).withColumn("_n", following).where(F.col("_n").isNotNull() & ~F.arrays_overlap("_e", "_n")).drop("_e", "_n")


def broken_positions(rows: DataFrame, group: str, position: str) -> DataFrame:
    """Per group n and whether its positions aren't 1 to n, each once."""
    n = F.count("*")
    return rows.groupBy(group).agg(n.alias("n"), ((F.max(position) != n) | (F.countDistinct(position) != n) | (F.min(position) != 1)).alias("broken"))


def sections(parts: DataFrame, course: str, order: list[str], length: str) -> DataFrame:
    """Adds pos (from 1), start_m and end_m: lengths of a course's sections added up in order."""
    by = Window.partitionBy(course).orderBy(*order)
    placed = parts.withColumns({"pos": F.row_number().over(by).cast("long"), "end_m": F.sum(length).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    return placed.withColumn("start_m", F.col("end_m") - F.col(length))


def merged_intervals(intervals: DataFrame, group: str, join_gap: float, least: float) -> DataFrame:
    """Intervals (group, a, b) merged where they overlap or lie within join_gap of each other, and kept if `least` long."""
    by = Window.partitionBy(group).orderBy("a", "b")
    reach = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = islands(intervals.withColumn("_new", reach.isNull() | (F.col("a") > reach + join_gap)), F.col("_new"), [group], ["a", "b"], "_run")
    return runs.groupBy(group, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n")).where(F.col("b") - F.col("a") >= least).drop("_run")


def cut_edges(legs: DataFrame, cuts: DataFrame, snap_m: float, track: str = "track_id") -> DataFrame:
    """Tracks cut where points (track, cut_id, lon, lat) project on them: track, from_m, to_m, vertices between, and the ids of
    the cuts at both ends (null at the track's own ends). A point farther than snap_m from its track cuts nothing."""
    from waystone.operators.joins import linear_reference

    placed = linear_reference(cuts.withColumnRenamed("cut_id", "landmark_id"), legs, track).where(F.round("offset_m", 6) <= snap_m)
    ends = legs.groupBy(track).agg(F.min("d0").alias("a"), F.max("d1").alias("b"))
    at = placed.select(track, F.col("along_m").alias("d"), F.col("landmark_id").alias("cut_id"))
    ends = ends.select(track, F.explode(F.array("a", "b")).alias("d"), F.lit(None).cast(at.schema["cut_id"].dataType).alias("cut_id"))
    one = at.unionByName(ends).groupBy(track, "d").agg(F.min("cut_id").alias("cut_id"))
    by = Window.partitionBy(track).orderBy("d")
    edges = one.select(track, F.col("d").alias("from_m"), F.col("cut_id").alias("from_cut"), F.lead("d").over(by).alias("to_m"), F.lead("cut_id").over(by).alias("to_cut")).where("to_m is not null")
    marks = legs.select(track, F.col("d0").alias("at"), F.lit(1).alias("vertex")).unionByName(edges.select(track, F.col("from_m").alias("at"), F.lit(0).alias("vertex")))
    order, own = Window.partitionBy(track).orderBy("at", "vertex"), F.when(F.col("vertex") == 0, F.col("at"))
    owner = marks.withColumns({"from_m": F.max(own).over(order.rowsBetween(Window.unboundedPreceding, 0)), "to_m": F.min(own).over(order.rowsBetween(0, Window.unboundedFollowing))})
    owner = owner.where("vertex = 1 and at > from_m + 0.001 and (to_m is null or at < to_m - 0.001)")  # a vertex within a millimetre of a cut is that cut
    inner = owner.groupBy(track, "from_m").agg(F.count("*").alias("vertices"))
    return edges.join(inner, [track, "from_m"], "left").withColumn("vertices", F.coalesce("vertices", F.lit(0)))


def extrema_buckets(points: DataFrame, value: str, buckets: int, track: str = "track_id") -> DataFrame:
    """Down-sampling that keeps each equal-count bucket's least and greatest value and both ends. track, pos, value."""
    by = Window.partitionBy(track)
    n = F.count("*").over(by)
    numbered = points.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(by.orderBy("pos")) - 1).withColumn("_n", n)
    bucket = numbered.withColumn("_b", F.floor(F.col("_i") * buckets / F.col("_n")))
    ends = bucket.where((F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1)).select(track, "pos")
    low = bucket.groupBy(track, "_b").agg(F.min(F.struct(value, "pos")).alias("lo"), F.max(F.struct(F.col(value), (-F.col("pos")).alias("m"))).alias("hi"))
    picked = low.select(track, F.explode(F.array(F.col("lo.pos"), -F.col("hi.m"))).alias("pos")).unionByName(ends).distinct()
    return points.join(picked, [track, "pos"], "left_semi").select(track, "pos", value)


def reversals(points: DataFrame, value: str, track: str = "track_id") -> DataFrame:
    """Points where the direction of a value turns; no change keeps the direction before. track, pos."""
    by = Window.partitionBy(track).orderBy("pos")
    sign = F.nullif(F.signum(F.col(value) - F.lag(value).over(by)), F.lit(0.0))
    known = points.where(F.col(value).isNotNull()).withColumn("_s", sign).withColumn("_d", F.last("_s", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    turned = known.withColumn("_t", F.lag("_d").over(by)).withColumn("_p", F.lag("pos").over(by))
    return turned.where(F.col("_s").isNotNull() & F.col("_t").isNotNull() & (F.col("_s") != F.col("_t"))).select(track, F.col("_p").alias("pos"))
