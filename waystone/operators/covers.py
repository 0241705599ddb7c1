"""Exact stretches of lines: inside rings, along other lines, between banks. A stretch is an interval (s, e) of the way along its line;
stretches are united along each line, and what they leave is visible. Legs are rows (line_id, pos, x0, y0, x1, y1) in one plane, rings
the same with ring_id, their last leg closing them; holes and further parts are edges of the same ring_id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone.functions.geo import planar_distance
from waystone.operators.coverage import ENDS, _cells, _stripes, inside_rings
from waystone.operators.storage import removed, settled
from waystone.operators.tracks import islands

#: Lengths and parts of a leg below these are rounding.
LENGTH_NOISE, PART_NOISE = 1e-9, 1e-12


def measured(legs: DataFrame) -> DataFrame:
    """Legs with m, their length, and d0, the way along the line before them."""
    before = Window.partitionBy("line_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sized = legs.withColumn("m", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return sized.withColumn("d0", F.coalesce(F.sum("m").over(before), F.lit(0.0)))


def _stage(df: DataFrame, name: str, values: dict[str, Column]) -> DataFrame:
    """df with a struct of values, computed once a row: the optimizer pastes no expression from behind a generator into later ones,
    which would make them too long to compile."""
    return df.withColumn(name, F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def with_capsule_part(df: DataFrame, leg: tuple[str, ...], edge: tuple[str, ...], reach: float) -> DataFrame:
    """Adds part, struct(t0, t1): the part of a leg (0 to 1) within reach of an edge; null if that is a point or nothing.

    What lies within reach of an edge is a rectangle with a disc at each end. It is convex, so a leg has one part in it: from the
    first to the last of its parts in the three."""
    px, py, px1, py1 = map(F.col, leg)
    qx, qy, qx1, qy1 = map(F.col, edge)
    c = lambda name: F.col(f"_p.{name}")
    out = _stage(df, "_p", {"dx": px1 - px, "dy": py1 - py, "ex": qx1 - qx, "ey": qy1 - qy, "fx": px - qx, "fy": py - qy, "gx": px - qx1, "gy": py - qy1})
    dx, dy, ex, ey, fx, fy, gx, gy = map(c, ("dx", "dy", "ex", "ey", "fx", "fy", "gx", "gy"))
    size, width = dx * dx + dy * dy, ex * ex + ey * ey
    first = {"size": size, "width": width, "h0": F.try_divide(-(fx * dx + fy * dy), size), "h1": F.try_divide(-(gx * dx + gy * dy), size)}
    first |= {"k0": F.try_divide(fx * fx + fy * fy - reach * reach, size), "k1": F.try_divide(gx * gx + gy * gy - reach * reach, size)}
    first |= {"across": ex * fy - ey * fx, "aside": ex * dy - ey * dx, "along": fx * ex + fy * ey, "ahead": dx * ex + dy * ey}
    out = _stage(out, "_q", first)
    c = lambda name: F.col(f"_q.{name}")
    wide = reach * F.sqrt(c("width"))
    root = lambda k: F.when(c(f"h{k}") * c(f"h{k}") >= c(f"k{k}"), F.sqrt(c(f"h{k}") * c(f"h{k}") - c(f"k{k}")))
    out = _stage(out, "_r", {"r0": root(0), "r1": root(1), "a0": F.try_divide(-wide - c("across"), c("aside")), "a1": F.try_divide(wide - c("across"), c("aside")), "b0": F.try_divide(-c("along"), c("ahead")), "b1": F.try_divide(c("width") - c("along"), c("ahead"))})
    r = lambda name: F.col(f"_r.{name}")
    level = F.abs(c("across")) <= wide  # a leg along the edge is in its strip for good, or never
    square = (c("along") >= 0) & (c("along") <= c("width"))
    low = F.greatest(F.when(c("aside") != 0, F.least(r("a0"), r("a1"))).when(level, -math.inf), F.when(c("ahead") != 0, F.least(r("b0"), r("b1"))).when(square, -math.inf))
    high = F.least(F.when(c("aside") != 0, F.greatest(r("a0"), r("a1"))).when(level, math.inf), F.when(c("ahead") != 0, F.greatest(r("b0"), r("b1"))).when(square, math.inf))
    block = (c("width") > 0) & ((c("aside") != 0) | level) & ((c("ahead") != 0) | square)
    out = _stage(out, "_s", {"low": F.when(block, low), "high": F.when(block, high)})
    flat = F.col("_s.low") <= F.col("_s.high")
    t0 = F.least(c("h0") - r("r0"), c("h1") - r("r1"), F.when(flat, F.col("_s.low")))
    t1 = F.greatest(c("h0") + r("r0"), c("h1") + r("r1"), F.when(flat, F.col("_s.high")))
    out = _stage(out, "_t", {"t0": t0, "t1": t1})
    t0, t1 = F.greatest(F.lit(0.0), F.col("_t.t0")), F.least(F.lit(1.0), F.col("_t.t1"))
    found = F.col("_t.t0").isNotNull() & (c("size") > 0) & (t1 - t0 > PART_NOISE)
    return out.withColumn("part", F.when(found, F.struct(t0.alias("t0"), t1.alias("t1")))).drop("_p", "_q", "_r", "_s", "_t")


def _ring_legs(legs: DataFrame, rings: DataFrame, cell: float, margin: float, other: bool) -> DataFrame:
    """Legs with each ring whose box they meet, found by cells; a ring's box and a leg's box may share several."""
    box = rings.groupBy("ring_id").agg(*[f(F.least(a, b) if f is F.min else F.greatest(a, b)).alias(n) for n, f, a, b in (("_w", F.min, "x0", "x1"), ("_e", F.max, "x0", "x1"), ("_s", F.min, "y0", "y1"), ("_n", F.max, "y0", "y1"))])
    dealt = box.withColumn("c", F.explode(_cells(F.col("_w"), F.col("_s"), F.col("_e"), F.col("_n"), cell, margin)))
    own = legs.withColumn("c", F.explode(_cells(*map(F.col, ENDS), cell)))
    meets = (F.greatest("x0", "x1") >= F.col("_w") - margin) & (F.least("x0", "x1") <= F.col("_e") + margin)
    meets = meets & (F.greatest("y0", "y1") >= F.col("_s") - margin) & (F.least("y0", "y1") <= F.col("_n") + margin)
    met = own.join(dealt, "c").where(meets & (F.col("line_id") != F.col("ring_id")) if other else meets)
    return met.select("line_id", "pos", "ring_id", *ENDS).distinct()


def inside_parts(legs: DataFrame, rings: DataFrame, cell: float, buffer: float = 0.0, other: bool = False) -> DataFrame:
    """Parts of legs inside rings, or within a buffer of their edges: line_id, pos, ring_id, t0, t1 (0 to 1 along the leg). Parts may
    overlap. other: a line's own ring, of the same id, is none of its covers.

    A leg meets the edges of its own strips of the rings near it. Where it crosses or touches them it is cut, and what is between
    two cuts lies inside or outside as a whole, as its middle does."""
    pairs = settled(_ring_legs(legs, rings, cell, buffer, other))
    edges, heights = _stripes(rings, buffer)
    strips = F.sequence(F.floor(F.least("y0", "y1") / F.col("_h")), F.floor(F.greatest("y0", "y1") / F.col("_h")))
    near = edges.select("ring_id", "_s", *[F.col(c).alias(f"r{c}") for c in ENDS])
    met = pairs.join(heights, "ring_id").withColumn("_s", F.explode(strips)).drop("_h").join(near, ["ring_id", "_s"])
    dx, dy, ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0")
    qx, qy = F.col("rx0") - F.col("x0"), F.col("ry0") - F.col("y0")
    cross, size = dx * ey - dy * ex, dx * dx + dy * dy
    t, u = F.try_divide(qx * ey - qy * ex, cross), F.try_divide(qx * dy - qy * dx, cross)
    along = F.try_divide(qx * dx + qy * dy, size)  # an edge on the leg's own line cuts it where the edge ends
    cuts = F.when(cross != 0, F.when(u.between(0.0, 1.0), F.array(t))).when(qx * dy == qy * dx, F.array(along, along + F.try_divide(ex * dx + ey * dy, size)))
    leg = ("line_id", "pos", "ring_id")
    inner = met.select(*leg, F.explode(cuts).alias("t")).where((F.col("t") > 0) & (F.col("t") < 1))
    whole = pairs.select(*leg, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    by = Window.partitionBy(*leg).orderBy("t")
    parts = inner.unionByName(whole).withColumn("t1", F.lead("t").over(by)).where(F.col("t1") - F.col("t") > PART_NOISE)
    parts = parts.select(*leg, F.col("t").alias("t0"), "t1").join(pairs, list(leg))
    middle = lambda c: F.col(f"{c}0") + (F.col("t0") + F.col("t1")) / 2 * (F.col(f"{c}1") - F.col(f"{c}0"))
    points = parts.select("line_id", "pos", "ring_id", "t0", "t1", middle("x").alias("x"), middle("y").alias("y"))
    out = inside_rings(points, rings, [*leg, "t0", "t1"]).where("inside").select(*leg, "t0", "t1")
    if buffer > 0:
        round_ = with_capsule_part(met, ENDS, tuple(f"r{c}" for c in ENDS), buffer).where("part is not null")
        out = out.unionByName(round_.select(*leg, "part.t0", "part.t1").distinct())
    return out


def near_parts(legs: DataFrame, references: DataFrame, distance: float, cell: float, same: tuple[str, ...] = (), most_degrees: float | None = None, where: Column | None = None) -> DataFrame:
    """Parts of legs within a distance of the legs of other lines: line_id, pos, other, t0, t1. same: columns that both have and that
    must agree; where: a condition on the references' columns, named r_..., and the legs'; most_degrees: legs that stand at a wider
    angle to each other, in either direction, don't run along each other, so a close crossing is no corridor."""
    step = max(cell, distance)
    dealt = legs.withColumn("c", F.explode(_cells(*map(F.col, ENDS), step, distance)))
    rest = [c for c in references.columns if c not in same]
    near = references.withColumn("c", F.explode(_cells(*map(F.col, ENDS), step))).select("c", *same, *[F.col(c).alias(f"r_{c}") for c in rest])
    met = dealt.join(near, ["c", *same]).where(F.col("line_id") != F.col("r_line_id"))
    if where is not None:
        met = met.where(where)
    if most_degrees is not None:
        v = [F.col(f"{p}{c}1") - F.col(f"{p}{c}0") for p in ("", "r_") for c in "xy"]
        sizes = F.hypot(v[0], v[1]) * F.hypot(v[2], v[3])
        met = met.where((sizes > 0) & (F.abs(v[0] * v[2] + v[1] * v[3]) + 1e-12 * sizes >= math.cos(math.radians(most_degrees)) * sizes))
    met = with_capsule_part(met, ENDS, tuple(f"r_{c}" for c in ENDS), distance).where("part is not null")
    return met.select("line_id", "pos", F.col("r_line_id").alias("other"), "part.t0", "part.t1").distinct()


def stretches(parts: DataFrame, legs: DataFrame) -> DataFrame:
    """Parts of measured() legs as stretches of their lines: s and e instead of pos, t0 and t1."""
    on = parts.join(legs.select("line_id", "pos", "m", "d0"), ["line_id", "pos"])
    s, e = F.col("d0") + F.col("t0") * F.col("m"), F.col("d0") + F.col("t1") * F.col("m")
    return on.select(*[c for c in parts.columns if c not in ("pos", "t0", "t1")], s.alias("s"), e.alias("e"))


def united(found: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches (keys, s, e) that overlap or touch as one."""
    by = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = found.withColumn("_new", F.when(F.col("s") <= reach + LENGTH_NOISE, 0).otherwise(1))
    numbered = starts.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_run")


def visible(found: DataFrame, legs: DataFrame, least: float = 1e-6) -> DataFrame:
    """What stretches (line_id, s, e) leave of the lines of measured() legs, in parts longer than least: line_id, part (from 1), s, e.
    A line that nothing covers is one part, one that is covered whole none."""
    ends = legs.groupBy("line_id").agg(F.max(F.col("d0") + F.col("m")).alias("s")).withColumn("e", F.col("s"))
    rows = found.select("line_id", "s", "e").unionByName(ends)
    by = Window.partitionBy("line_id").orderBy("s", "e")
    reach = F.coalesce(F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    gaps = rows.withColumn("_from", reach).where(F.col("s") - F.col("_from") > least)
    return gaps.select("line_id", F.row_number().over(Window.partitionBy("line_id").orderBy("_from")).alias("part"), F.col("_from").alias("s"), F.col("s").alias("e"))


def suppressed(found: DataFrame, legs: DataFrame) -> DataFrame:
    """Per line of measured() legs its length, and how much of it stretches leave visible and suppress: length, shown, covered."""
    whole = legs.groupBy("line_id").agg(F.sum("m").alias("length"))
    seen = visible(found, legs, 0.0).groupBy("line_id").agg(F.sum(F.col("e") - F.col("s")).alias("shown"))
    out = whole.join(seen, "line_id", "left").withColumn("shown", F.coalesce("shown", F.lit(0.0)))
    return out.withColumn("covered", F.greatest(F.lit(0.0), F.col("length") - F.col("shown")))


def thinned(legs: DataFrame, distance: float, ratio: float, cell: float, same: tuple[str, ...] = (), most_degrees: float | None = None) -> DataFrame:
    """Lines, the longest first (ties by line_id), are kept unless a share of `ratio` or more of them lies within a distance of lines
    kept before: line_id, length, dropped. Lines of another group (the columns `same`) don't count, and a line is in one group.

    What each line shares with each longer one is found once, by cells, and united. A line is decided as soon as the lines kept so far
    cover enough of it, or those that may still be kept can't; the longest open line always is, and all that are far from any
    other at once."""
    at = settled(measured(legs))
    sizes = settled(at.groupBy("line_id").agg(F.sum("m").alias("length")))
    own = at.select("line_id", "pos", *same, *ENDS).join(sizes, "line_id")
    longer = (F.col("r_length") > F.col("length")) | ((F.col("r_length") == F.col("length")) & (F.col("r_line_id") < F.col("line_id")))
    shared = settled(united(stretches(near_parts(own, own, distance, cell, same, most_degrees, longer), at), ["line_id", "other"]))
    state = settled(sizes.withColumn("dropped", F.lit(None).cast("boolean")))
    by = Window.partitionBy("line_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = lambda end: F.greatest(F.lit(0.0), end - F.greatest("s", F.coalesce(F.max(end).over(by), F.col("s"))))
    while True:
        open_ = state.where("dropped is null")
        if open_.isEmpty():
            removed(at, sizes, shared)
            return state
        others = state.select(F.col("line_id").alias("other"), F.col("dropped").alias("_gone"))
        met = shared.join(open_.select("line_id"), "line_id", "left_semi").join(others, "other").where(~F.coalesce("_gone", F.lit(False)))
        kept_end = F.when(F.col("_gone").isNotNull(), F.col("e"))
        sums = met.select("line_id", F.coalesce(new(kept_end), F.lit(0.0)).alias("sure"), new(F.col("e")).alias("may")).groupBy("line_id").agg(F.sum("sure").alias("sure"), F.sum("may").alias("may"))
        enough = lambda c: F.coalesce(c, F.lit(0.0)) / F.greatest("length", F.lit(1e-6)) >= ratio
        verdict = F.when(F.col("dropped").isNotNull(), F.col("dropped")).when(enough("sure"), True).when(~enough("may"), False)
        after = settled(state.join(sums, "line_id", "left").select("line_id", "length", verdict.alias("dropped")))
        removed(state)
        state = after


def places(legs: DataFrame, at: DataFrame) -> DataFrame:
    """Where ways along lines lie: at (line_id, d, and what tells its rows apart) with x and y, on measured() legs; before a line's
    start its start, beyond its end its end."""
    leg = F.struct("d0", "m", *ENDS)
    rows = legs.where("m > 0").select("line_id", F.col("d0").alias("d"), F.lit(0).alias("_k"), leg.alias("_leg"))
    both = rows.unionByName(at.withColumns({"_k": F.lit(1), "_leg": F.lit(None).cast(rows.schema["_leg"].dataType)}), allowMissingColumns=True)
    by = Window.partitionBy("line_id").orderBy("d", "_k").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_leg", F.last("_leg", True).over(by)).where("_k = 1 and _leg is not null")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("d") - F.col("_leg.d0")) / F.col("_leg.m")))
    on = lambda c: F.col(f"_leg.{c}0") + t * (F.col(f"_leg.{c}1") - F.col(f"_leg.{c}0"))
    return got.select(*at.columns, on("x").alias("x"), on("y").alias("y"))


def flanked_stretches(legs: DataFrame, banks: DataFrame, reach: float, cell: float, step: float = 0.75) -> DataFrame:
    """Stretches of measured() legs that run between two banks (legs of other lines): line_id, s, e.

    A line is cut in equal intervals of at most `step` (1 to 1,024 of them). Across the middle of each, square to the line's course
    about it, a section reaches out to 2.25 times the nearest bank's distance and a quarter more, 0.75 at least; banks on both
    sides of it, farther than 0.2, flank the interval. Runs of two or more intervals that are `step` long count, and lines that
    are flanked whole. A line whose nearest bank is beyond `reach` isn't flanked there."""
    widest = max(0.75, 2.25 * reach + 0.25)
    lines = legs.groupBy("line_id").agg(F.sum("m").alias("length")).where("length > 1e-6")
    n = F.greatest(F.lit(1), F.least(F.lit(1024), F.ceil(F.col("length") / step))).cast("int")
    cut = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("size", F.col("length") / F.col("n"))
    around = F.least(F.greatest(F.col("length") * 0.015, F.lit(0.15)), F.lit(0.7))
    centre = F.col("size") * (F.col("i") + 0.5)
    ways = F.array(F.greatest(F.lit(0.0), centre - around), centre, F.least(F.col("length"), centre + around))
    at = cut.select("line_id", "i", F.posexplode(ways).alias("k", "d"))
    put = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    p = places(legs, at).groupBy("line_id", "i").agg(*[put(k, c).alias(f"{c}{k}") for k in range(3) for c in "xy"])
    size = F.hypot(F.col("x2") - F.col("x0"), F.col("y2") - F.col("y0"))
    section = p.where(size > 1e-9).select("line_id", "i", F.col("x1").alias("x"), F.col("y1").alias("y"), (-(F.col("y2") - F.col("y0")) / size).alias("nx"), ((F.col("x2") - F.col("x0")) / size).alias("ny"))
    span = _cells(F.col("x") - widest, F.col("y") - widest, F.col("x") + widest, F.col("y") + widest, max(cell, widest))
    near = banks.withColumn("c", F.explode(_cells(*map(F.col, ENDS), max(cell, widest)))).select("c", F.col("line_id").alias("bank"), *[F.col(c).alias(f"b{c}") for c in ENDS])
    met = section.withColumn("c", F.explode(span)).join(near, "c").where(F.col("line_id") != F.col("bank"))
    bx, by_, ux, uy = F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"), F.col("bx0") - F.col("x"), F.col("by0") - F.col("y")
    turn = F.col("nx") * by_ - F.col("ny") * bx
    off, on = F.try_divide(ux * by_ - uy * bx, turn), F.try_divide(ux * F.col("ny") - uy * F.col("nx"), turn)
    hit = F.when(on.between(0.0, 1.0), off)
    sides = met.groupBy("line_id", "i").agg(F.min(planar_distance("x", "y", "bx0", "by0", "bx1", "by1")).alias("_d"), F.min(F.when(hit > 0.2, hit)).alias("_l"), F.min(F.when(hit < -0.2, -hit)).alias("_r"))
    half = F.greatest(F.lit(0.75), F.col("_d") * 2.25 + 0.25)
    marked = cut.join(sides, ["line_id", "i"], "left").withColumn("flanked", F.coalesce((F.col("_d") <= reach) & (F.col("_l") <= half) & (F.col("_r") <= half), F.lit(False)))
    runs = islands(marked.select("line_id", "i", "n", "size", "flanked"), ~F.col("flanked"), ["line_id"], ["i"], "run").where("flanked")
    found = runs.groupBy("line_id", "run").agg(F.min("i").alias("a"), (F.max("i") + 1).alias("b"), F.first("n").alias("n"), F.first("size").alias("size"))
    long = (F.col("b") - F.col("a") >= 2) & ((F.col("b") - F.col("a")) * F.col("size") >= step - LENGTH_NOISE)
    return found.where(long | ((F.col("a") == 0) & (F.col("b") == F.col("n")))).select("line_id", (F.col("a") * F.col("size")).alias("s"), (F.col("b") * F.col("size")).alias("e"))
