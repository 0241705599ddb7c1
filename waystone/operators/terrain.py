"""Elevation grids as cell rows (tile, row, col, z): smoothing, gradients, contour levels and segments."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waystone.operators.graph import chains
from waystone.operators.storage import settled

#: Intervals of contours that read well.
INTERVALS = (5, 10, 20, 25, 50, 100, 200, 250, 500, 1000, 2000)


def _pass(cells: DataFrame, kernel: dict[int, float], axis: str) -> DataFrame:
    """One direction of a separable kernel; missing cells and cells beyond the edge leave their weight to the others."""
    spread = cells.where("z is not null").select("tile", "row", "col", "z", F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(float(w)).alias("w")) for o, w in kernel.items()])).alias("k"))
    moved = spread.withColumn(axis, F.col(axis) - F.col("k.o")).groupBy("tile", "row", "col").agg((F.sum(F.col("k.w") * F.col("z")) / F.sum("k.w")).alias("z"))
    return cells.select("tile", "row", "col").join(moved, ["tile", "row", "col"], "left")


def smoothed(cells: DataFrame, kernel: dict[int, float]) -> DataFrame:
    return _pass(_pass(cells, kernel, "col"), kernel, "row")


def gradient(cells: DataFrame) -> DataFrame:
    """Adds gx and gy, central differences; null at edges and missing neighbours. Cells of a tile must be all there."""
    central = lambda a, b: (F.lead("z").over(Window.partitionBy("tile", a).orderBy(b)) - F.lag("z").over(Window.partitionBy("tile", a).orderBy(b))) / 2
    return cells.withColumns({"gx": central("row", "col"), "gy": central("col", "row")})


def decoded(r: Column, g: Column, b: Column) -> Column:
    """Metres of a colour-coded pixel; null outside -500 to 9000."""
    z = r * 256.0 + g + b / 256.0 - 32768.0
    return F.when(z.between(-500.0, 9000.0), z)


def level_plan(cells: DataFrame, target: int = 12, most: int = 24) -> DataFrame:
    """Contour levels of each tile: multiples of a readable interval between the 2nd and 98th percentile, thinned to `most`;
    the middle where there is none. tile, levels."""
    p = cells.where("z is not null").groupBy("tile").agg(F.percentile("z", F.array(F.lit(0.02), F.lit(0.98))).alias("p"), F.count("*").alias("n")).where("n >= 9")
    low, high = F.element_at("p", 1), F.element_at("p", 2)
    want = F.greatest((high - low) / target, F.lit(5.0))
    step = F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, INTERVALS)), lambda i: i >= want)), F.lit(INTERVALS[-1]))
    ranged = p.select("tile", low.alias("low"), high.alias("high"), step.alias("step"))
    first, last = F.ceil(F.col("low") / F.col("step")) * F.col("step"), F.floor(F.col("high") / F.col("step")) * F.col("step")
    every = F.when(first <= last, F.sequence(first, last, F.col("step").cast("long"))).otherwise(F.array(F.bround((F.col("low") + F.col("high")) / 2).cast("long")))
    stride = F.ceil(F.size(every) / F.lit(most))
    return ranged.select("tile", F.filter(every, lambda x, i: i % stride == 0).alias("levels"))


def contour_segments(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """Marching squares: per 2 x 2 cells and level the segments between interpolated edge points. tile, row, col, level,
    x0, y0, x1, y1 (x along columns). A saddle gives two segments that keep the low corners apart; cells with a missing
    corner give none. side0, side1: the grid side that each end lies on (row, col and 0 along the row, 1 down the column), which
    tells equal ends without comparing fractions."""
    right, down = Window.partitionBy("tile", "row").orderBy("col"), Window.partitionBy("tile", "col").orderBy("row")
    square = cells.withColumns({"b": F.lead("z").over(right), "d": F.lead("z").over(down)}).withColumn("c", F.lead("b").over(down))
    full = square.where("z is not null and b is not null and c is not null and d is not null").join(levels.select("tile", F.explode("levels").alias("level")), "tile")
    at = full.where((F.least("z", "b", "c", "d") < F.col("level")) & (F.greatest("z", "b", "c", "d") >= F.col("level")))
    bit = lambda c, k: F.when(F.col(c) >= F.col("level"), k).otherwise(0)
    cut = lambda p, q: (F.col("level") - F.col(p)) / (F.col(q) - F.col(p))
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    side = lambda down, across, kind: F.struct((F.col("row") + down).cast("long").alias("row"), (F.col("col") + across).cast("long").alias("col"), F.lit(kind).alias("kind"))
    point = lambda px, py, down, across, kind: F.struct(px.alias("x"), py.alias("y"), side(down, across, kind).alias("side"))
    top, left = lambda: point(x + cut("z", "b"), y, 0, 0, 0), lambda: point(x, y + cut("z", "d"), 0, 0, 1)
    bottom, edge = lambda: point(x + cut("d", "c"), y + 1, 1, 0, 0), lambda: point(x + 1, y + cut("b", "c"), 0, 1, 1)
    line = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    case = bit("z", 8) + bit("b", 4) + bit("c", 2) + bit("d", 1)
    segments = (
        F.when(F.col("k").isin(1, 14), F.array(line(left(), bottom()))).when(F.col("k").isin(2, 13), F.array(line(bottom(), edge()))).when(F.col("k").isin(3, 12), F.array(line(left(), edge())))
        .when(F.col("k").isin(4, 11), F.array(line(top(), edge()))).when(F.col("k").isin(6, 9), F.array(line(top(), bottom()))).when(F.col("k").isin(7, 8), F.array(line(top(), left())))
        .when(F.col("k") == 5, F.array(line(top(), edge()), line(left(), bottom()))).when(F.col("k") == 10, F.array(line(top(), left()), line(bottom(), edge())))
    )
    return at.withColumn("k", case).withColumn("s", F.explode(segments)).select("tile", "row", "col", "level", F.col("s.p.x").alias("x0"), F.col("s.p.y").alias("y0"), F.col("s.q.x").alias("x1"), F.col("s.q.y").alias("y1"), F.col("s.p.side").alias("side0"), F.col("s.q.side").alias("side1"))


def contour_paths(segments: DataFrame, across: bool = False, block: int = 64) -> DataFrame:
    """Contours of contour_segments() stitched to lines: tile, level, line (the least segment of it), closed, pos, x, y, a ring ending
    where it began. Each segment is in one line.

    Two segments go on in each other where they end on one grid side. across: rows and columns number one grid over all tiles, whose
    borders share their samples, and lines go on from tile to tile (tile: the least one). Segments are strung in blocks of so many
    rows and columns (shifted by half, so that a grid's first edge is no border); only strings that leave their block go on from block to block, by pointer jumping. Vertices are rows, never one
    array. A line is read from the end whose segment is less, a ring from its least segment in that one's direction."""
    kind = lambda c: segments.schema[c].dataType.simpleString()
    columns = f"part array<double>, i int, n int, way array<double>, turned boolean, a string, b string, ring boolean, tile {kind('tile')}, level {kind('level')}, px double, py double, qx double, qy double"
    place = F.lit(None).cast(segments.schema["tile"].dataType) if across else F.col("tile")
    own = segments.select(place.alias("_place"), F.floor((F.col("row") + block // 2) / block).alias("_rb"), F.floor((F.col("col") + block // 2) / block).alias("_cb"), "tile", "level", "row", "col", "x0", "y0", "x1", "y1", "side0", "side1")
    strung = settled(own.groupBy("_place", "_rb", "_cb").applyInArrow(_strung(block, columns), columns))
    inside = strung.where("a is null and b is null")
    whole = inside.select(F.col("part").alias("line"), F.col("i").alias("pos"), "n", F.col("ring").alias("closed"), "tile", "level", "px", "py", "qx", "qy")
    parts = strung.where("(a is not null or b is not null) and i = 0")
    if not parts.isEmpty():
        whole = whole.unionByName(_over_blocks(strung.where("a is not null or b is not null"), parts.select(F.col("part").alias("way"), "a", "b", "n")))
    v = lambda pos, x, y: F.struct(pos.alias("pos"), F.col(x).alias("x"), F.col(y).alias("y"))
    ends = F.when(F.col("pos") == F.col("n") - 1, F.array(v(F.col("pos"), "px", "py"), v(F.col("pos") + 1, "qx", "qy"))).otherwise(F.array(v(F.col("pos"), "px", "py")))
    return whole.select("tile", "level", F.array_join(F.transform("line", lambda c: c.cast("long").cast("string")), "/").alias("line"), "closed", F.explode(ends).alias("e")).select("tile", "level", "line", "closed", "e.pos", "e.x", "e.y")


def _over_blocks(segments: DataFrame, parts: DataFrame) -> DataFrame:
    """Strings that leave their block (way, a, b: the grid sides of open ends, n) put together, with the places of their segments."""
    placed = chains(parts.select("way", "a", "b")).join(parts, "way")
    by = Window.partitionBy("run").orderBy("pos")
    after, before = F.lead(F.array("a", "b")).over(by), F.lag(F.array("a", "b")).over(by)
    meets = lambda other, c: F.coalesce(F.array_contains(F.array_compact(other), F.col(c)), F.lit(False))
    both = before.isNotNull() & meets(before, "a") & meets(before, "b")  # a ring of two strings
    turned = F.when(both, F.col("a") == before[0]).when(after.isNotNull(), ~meets(after, "b")).when(before.isNotNull(), ~meets(before, "a")).otherwise(False)
    ways = placed.withColumn("_t", turned).withColumns({"_u": F.when(F.col("_t"), F.col("b")).otherwise(F.col("a")), "_v": F.when(F.col("_t"), F.col("a")).otherwise(F.col("b"))})
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ways = ways.withColumns({"_from": F.sum("n").over(by) - F.col("n"), "_n": F.sum("n").over(every), "closed": F.coalesce((F.first("_u").over(every) == F.last("_v").over(every)) & (F.count("*").over(every) > 1), F.lit(False))})
    met = segments.join(ways.select(F.col("way").alias("part"), "run", "_t", "_from", "_n", "closed"), "part")
    met = settled(met.withColumns({"g": (F.col("_from") + F.when(F.col("_t"), F.col("n") - 1 - F.col("i")).otherwise(F.col("i"))).cast("int"), "turned": F.col("turned") != F.col("_t")}))
    low = F.min(F.struct("way", "g", "turned"))
    ends = F.min_by("way", "g").alias("first"), F.max_by("way", "g").alias("last")
    runs = met.groupBy("run").agg(low.alias("low"), F.min("tile").alias("least"), *ends)
    rows = met.join(runs, "run")
    back = F.when(F.col("closed"), F.col("low.turned")).otherwise(F.when(F.col("first") == F.col("last"), F.col("low.turned")).otherwise(F.col("last") < F.col("first")))
    at = F.when(F.col("closed"), F.pmod(F.when(back, F.col("low.g") - F.col("g")).otherwise(F.col("g") - F.col("low.g")), F.col("_n"))).otherwise(F.when(back, F.col("_n") - 1 - F.col("g")).otherwise(F.col("g")))
    flip = back != F.col("_t")
    turn = lambda p, q: F.when(flip, F.col(q)).otherwise(F.col(p))
    return rows.select(F.col("low.way").alias("line"), at.cast("int").alias("pos"), F.col("_n").cast("int").alias("n"), "closed", F.col("least").alias("tile"), "level", turn("px", "qx").alias("px"), turn("py", "qy").alias("py"), turn("qx", "px").alias("qx"), turn("qy", "py").alias("qy"))


def _strung(block: int, columns: str):
    """Of one block's segments the strings, as rows of segments in order: part (the string's least segment), i of n, turned (read from
    its end to its start), the grid sides a and b at which the string's first and last segment leave the block, and whether it is a ring."""
    target = to_arrow_schema(StructType.fromDDL(columns))

    def run(table):
        c = {k: table[k].to_pylist() for k in ("tile", "level", "row", "col", "x0", "y0", "x1", "y1", "side0", "side1")}
        seen: dict = {}
        keys = []
        for k in sorted(range(len(c["tile"])), key=lambda k: tuple(c[x][k] for x in ("x0", "y0", "x1", "y1"))):
            cell = (float(c["tile"][k]), float(c["level"][k]), float(c["row"][k]), float(c["col"][k]))
            seen[cell] = seen.get(cell, 0) + 1
            keys.append(((*cell, float(seen[cell])), k))
        keys.sort()
        way, at = [w for w, _ in keys], [k for _, k in keys]  # segments by number, in the order of their keys
        side = lambda k, e: tuple(c[f"side{e}"][k][f] for f in ("row", "col", "kind"))
        ends: dict = {}
        for w, k in enumerate(at):
            for e in (0, 1):
                ends.setdefault((c["level"][k], side(k, e)), []).append((w, e))

        def leaves(r, col, kind):
            other = (r - 1, col) if kind == 0 else (r, col - 1)
            return any((p + block // 2) // block != (q + block // 2) // block for p, q in zip((r, col), other, strict=True))

        nxt = {}
        for (_, s), met in ends.items():
            if len(met) == 2 and met[0][0] != met[1][0] and not leaves(*s):
                nxt[met[0]], nxt[met[1]] = met[1], met[0]
        out, done = [], [False] * len(at)

        def follow(w, e):
            """Segments from w on, which is left by its end e, each with whether it is turned."""
            line = [(w, e == 0)]
            done[w] = True
            while (go := nxt.get((w, e))) is not None and not done[go[0]]:
                w, e = go[0], 1 - go[1]
                done[w] = True
                line.append((w, e == 0))
            return line

        def put(line, ring):
            open_ = lambda w, e: None if not leaves(*side(at[w], e)) else json.dumps([None if table_place is None else str(table_place), str(c["level"][at[w]]), *side(at[w], e)])
            a = b = None
            if not ring:
                a, b = open_(line[0][0], 1 if line[0][1] else 0), open_(line[-1][0], 0 if line[-1][1] else 1)
            part = way[min(w for w, _ in line)]
            for i, (w, t) in enumerate(line):
                k = at[w]
                p, q = ("1", "0") if t else ("0", "1")
                out.append((part, i, len(line), way[w], t, a, b, ring, c["tile"][k], c["level"][k], c["x" + p][k], c["y" + p][k], c["x" + q][k], c["y" + q][k]))

        table_place = table["_place"][0].as_py()
        for w in range(len(at)):  # the end of less key is met first
            if not done[w] and ((w, 0) not in nxt or (w, 1) not in nxt):
                put(follow(w, 1 if (w, 0) not in nxt else 0), False)
        for w in range(len(at)):
            if not done[w]:
                put(follow(w, 1), True)
        cells = list(zip(*out, strict=True)) if out else [()] * len(target)
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(cells, target, strict=True)], schema=target)

    return run
