"""Graph jobs as loops of joins: components, chains, cycles, cores and shortest paths. Every round is a table in the
shared folder; loops end when nothing changes, or raise when `rounds` don't suffice."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waystone.functions.geo import line_distance
from waystone.operators.folds import folded
from waystone.operators.storage import removed, settled, union_all


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of edges (a, b): (id, component), the least id of each; null ends are no edges.

    Each node hooks to its least smaller neighbour and pointers jump to the roots; then edges between different roots alone go on. So a
    round leaves half of the nodes of the last but one at most, and all rounds together cost little more than the first."""
    every = settled(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    left, levels = every.where("a < b"), []
    for _ in range(rounds):
        if left.isEmpty():
            break
        up = _rooted(settled(left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))))
        levels.append(up)
        of_a, of_b = up.select(F.col("id").alias("a"), F.col("root").alias("ra")), up.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        moved = left.join(of_b, "b").select("a", "rb").join(of_a, "a", "left").select("rb", F.coalesce("ra", "a").alias("ra"))
        left = settled(moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    else:
        raise RuntimeError("components: not settled")
    alone = every.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    if not levels:
        return settled(alone.distinct())
    found = levels[-1].withColumnRenamed("root", "component")
    for up in reversed(levels[:-1]):
        top = found.select(F.col("id").alias("root"), "component")
        found = settled(found.unionByName(up.join(top, "root", "left").select("id", F.coalesce("component", "root").alias("component"))))
    least = found.select(F.col("component").alias("id"), "component").distinct()
    return settled(found.unionByName(least).unionByName(alone).groupBy("id").agg(F.min("component").alias("component")))


def _rooted(up: DataFrame, rounds: int = 64) -> DataFrame:
    """Nodes (id, root: a lesser node) with the node at which their pointers end. Nodes that are there go no further."""
    ended, going, whole = [], up, up
    for _ in range(rounds):
        ahead = whole.select(F.col("id").alias("root"), F.col("root").alias("far"))
        met = settled(going.join(ahead, "root", "left").select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNull().alias("ended")))
        ended.append(met.where("ended").select("id", "root"))
        going = met.where("not ended").select("id", "root")
        if going.isEmpty():
            return union_all(ended)
        whole = union_all([*ended, going])
    raise RuntimeError("components: pointers not settled")


def grouped_by_reference(items: DataFrame) -> DataFrame:
    """Items (item, ref) that share a reference, directly or through others, are one group: (item, component: its least item).

    The items of a reference are linked to its least one, so a reference that many items share costs one edge each."""
    held = items.where("item is not null and ref is not null").select("item", "ref")
    first = held.groupBy("ref").agg(F.min("item").alias("least"))
    found = components(held.join(first, "ref").select(F.col("item").alias("a"), F.col("least").alias("b")))
    return found.select(F.col("id").alias("item"), "component")


def reunited(parts: DataFrame) -> DataFrame:
    """Parts of rivers (id, a, b, name, wikidata) that share an end or a name are one: component (the least id), parts, and
    conflict, where they name several entries."""
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    refs = parts.select(F.col("id").alias("item"), F.explode(F.array_compact(F.array(node("a"), node("b"), F.concat(F.lit("="), F.col("name"))))).alias("ref"))
    met = grouped_by_reference(refs).withColumnRenamed("item", "id").join(parts.select("id", "wikidata"), "id")
    several = F.coalesce(F.min("wikidata") < F.max("wikidata"), F.lit(False))
    return met.groupBy("component").agg(F.count("*").alias("parts"), several.alias("conflict"))


def two_core(edges: DataFrame, rounds: int = 256) -> DataFrame:
    """Edges (edge_id, a, b) that are left when edges with an end of degree one go, again and again.

    A spur goes whole: edges are strung to chains where exactly two ends meet, and a chain with a loose end is removed in one round,
    whatever its length; the rounds between take loose edges one by one, as most spurs are short. What remains of a tree shrinks by
    its outermost chains; a loop (a = b) is its own company."""
    left = settled(edges.select("edge_id", "a", "b"))
    for turn in range(1, rounds + 1):
        ends = left.select("edge_id", F.explode(F.array("a", "b")).alias("n"))
        loose = ends.groupBy("n").agg(F.count("*").alias("d"), F.min("edge_id").alias("edge_id")).where("d = 1").select("edge_id").distinct()
        loose = settled(loose)
        if loose.isEmpty():
            removed(loose)
            return left
        if turn % 4:  # short spurs and twigs: edge by edge, which takes one table
            after = settled(left.join(loose, "edge_id", "left_anti"))
            removed(left, loose)
            left = after
            continue
        runs = chains(left.select(F.col("edge_id").alias("way"), "a", "b")).select(F.col("way").alias("edge_id"), "run")
        runs = settled(runs)
        gone = runs.join(loose, "edge_id", "left_semi").select("run").distinct()
        after = settled(left.join(runs.join(gone, "run", "left_semi").select("edge_id"), "edge_id", "left_anti"))
        removed(left, loose, runs)
        left = after
    raise RuntimeError("two_core: not settled")


def directed_cycles(links: DataFrame, rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """Cycles of ways (way, head, tail) that follow each other head to tail: (way, cycle: the least way of it), and ways that
    have no or several successors or predecessors, which take no part (way, problem).

    Along unique successors, the least way within 2^n steps is known after n rounds of pointer jumping."""
    follow = links.select("way", F.col("tail").alias("at")).join(links.select(F.col("way").alias("next"), F.col("head").alias("at")), "at").select("way", "next")
    out, into = follow.groupBy("way").agg(F.count("*").alias("o")), follow.groupBy(F.col("next").alias("way")).agg(F.count("*").alias("i"))
    degrees = links.select("way").join(out, "way", "left").join(into, "way", "left").select("way", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i"))
    degrees = settled(degrees)
    problems = degrees.where("o <> 1 or i <> 1").select("way", F.when(F.col("o") == 0, "no-successor").when(F.col("o") > 1, "many-successors").when(F.col("i") == 0, "no-predecessor").otherwise("many-predecessors").alias("problem"))
    good = degrees.where("o = 1 and i = 1").select("way")
    jump = settled(follow.join(good, "way", "left_semi").select("way", "next", F.least("way", "next").alias("low")))
    for _ in range(rounds):
        ahead = jump.select(F.col("way").alias("next"), F.col("next").alias("far"), F.col("low").alias("low2"))
        after = settled(jump.join(ahead, "next").select("way", F.col("far").alias("next"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        if after.count() == jump.count() and after.where("moved").isEmpty():
            return after.select("way", F.col("low").alias("cycle")), problems
        jump = after.select("way", "next", "low")
    raise RuntimeError("directed_cycles: not settled")


def degree_two_links(ends: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Which end of a way goes on in which end of another, where exactly two ends of ways (way, a, b) meet: way, side, w2, s2.
    held: nodes (id) where none goes on."""
    sides = _sides(ends)
    two = sides.groupBy("at").agg(F.count("*").alias("n")).where("n = 2").select("at")
    if held is not None:
        two = two.join(held.select(F.col("id").alias("at")), "at", "left_anti")
    meet = sides.join(two, "at", "left_semi")
    other = meet.select("at", F.col("way").alias("w2"), F.col("side").alias("s2"))
    return meet.join(other, "at").where("way <> w2").select("way", "side", "w2", "s2")


def _sides(ends: DataFrame) -> DataFrame:
    return ends.select("way", F.lit(0).alias("side"), F.col("a").alias("at")).unionByName(ends.select("way", F.lit(1).alias("side"), F.col("b").alias("at")))


def compatible_links(spans: DataFrame, rounds: int = 64) -> DataFrame:
    """Which end of a span goes on in which end of another: spans (way, line, semantic, grade, a, b and the outward unit vectors
    ax, ay, bx, by of both ends) meet at a node if their semantic and grade agree. Ends of one line are paired first, then
    the straightest, each end once: way, side, w2, s2.

    A pair that is the first choice of both its ends is taken, then the rest choose anew, which is what taking pairs in order
    gives. Pairs are of one node: the number of ends at a node bounds them."""
    end = lambda side, c: spans.select("way", F.lit(side).alias("side"), "line", "semantic", "grade", F.col(c).alias("at"), F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y"))
    ends = end(0, "a").unionByName(end(1, "b"))
    other = ends.select("at", "semantic", "grade", *[F.col(c).alias(f"{c}2") for c in ("way", "side", "line", "x", "y")])
    met = ends.join(other, ["at", "semantic", "grade"]).where("way < way2")
    key = F.struct((F.col("line") != F.col("line2")).cast("int").alias("o"), (F.col("x") * F.col("x2") + F.col("y") * F.col("y2")).alias("bend"), "way", "side", "way2", "side2")
    return paired(met.select("way", "side", F.col("way2").alias("w2"), F.col("side2").alias("s2"), key.alias("key")), rounds)


def paired(candidates: DataFrame, rounds: int = 64) -> DataFrame:
    """Links between ends (way, side, w2, s2, key: told apart by their order), each end used once, the least key first: way, side, w2,
    s2, in both directions.

    A candidate that is the first choice of both its ends is taken, then the rest choose anew, which is what taking them in order
    gives."""
    left = settled(candidates.select("way", "side", "w2", "s2", "key"))
    taken = left.where(F.lit(False)).select("way", "side", "w2", "s2")
    for _ in range(rounds):
        if left.isEmpty():
            return taken.unionByName(taken.select(F.col("w2").alias("way"), F.col("s2").alias("side"), F.col("way").alias("w2"), F.col("side").alias("s2")))
        each = left.select("way", "side", "key").unionByName(left.select(F.col("w2").alias("way"), F.col("s2").alias("side"), "key"))
        first = each.groupBy("way", "side").agg(F.min("key").alias("best"))
        again = first.select(F.col("way").alias("w2"), F.col("side").alias("s2"), F.col("best").alias("best2"))
        mutual = (F.col("key") == F.col("best")) & (F.col("key") == F.col("best2"))
        now = settled(left.join(first, ["way", "side"]).join(again, ["w2", "s2"]).where(mutual).select("way", "side", "w2", "s2"))
        taken = taken.unionByName(now)
        used = now.select("way", "side").unionByName(now.select(F.col("w2").alias("way"), F.col("s2").alias("side")))
        rest = left.join(used, ["way", "side"], "left_anti").join(used.select(F.col("way").alias("w2"), F.col("side").alias("s2")), ["w2", "s2"], "left_anti")
        after = settled(rest.select("way", "side", "w2", "s2", "key"))
        removed(left)
        left = after
    raise RuntimeError("paired: not settled")


def touching(ends: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of ends of different ways (way, ax, ay, bx, by) that lie within the tolerance of each other: way, side, w2, s2 and key, the
    nearer first, then by way and side. Ends meet in cells of that size, so none meets an end far away."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    side = lambda k, c: ends.select("way", F.lit(k).alias("side"), F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y"))
    every = side(0, "a").unionByName(side(1, "b")).where("x is not null and y is not null").withColumns({"cx": cell("x"), "cy": cell("y")})
    around = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = every.select(F.col("way").alias("w2"), F.col("side").alias("s2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(around).alias("c")).select("w2", "s2", "x2", "y2", "c.cx", "c.cy")
    met = every.join(other, ["cx", "cy"]).where("way < w2").withColumn("d", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).where(F.col("d") <= tolerance)
    return met.select("way", "side", "w2", "s2", F.struct("d", "way", "side", "w2", "s2").alias("key"))


def stitched(ends: DataFrame, tolerance: float) -> DataFrame:
    """Ways (way, ax, ay, bx, by, m: its length) joined end to end where ends touch within the tolerance, nearest first and each end
    once: way, run, pos, run_m and place, 1 for the longest run. A gap stays a gap: what doesn't touch is never bridged."""
    runs = chains(ends.select("way", F.lit(0).alias("a"), F.lit(0).alias("b")), links=paired(touching(ends, tolerance)))
    placed = runs.join(ends.select("way", "m"), "way")
    lengths = settled(placed.groupBy("run").agg(F.sum("m").alias("run_m")))
    from waystone.operators.ranks import global_position

    order = global_position(lengths.withColumn("_o", -F.col("run_m")), ["_o", "run"], "place").select("run", "run_m", "place")
    return placed.join(order, "run").select("way", "run", "pos", "run_m", "place")


def chains(ends: DataFrame, rounds: int = 64, links: DataFrame | None = None) -> DataFrame:
    """Ways (way, a, b) stitched where exactly two ends meet, or as links (way, side, w2, s2, both directions) say: (way, run,
    pos), run the least way of it, pos from 0 along it.

    Ends are states (way, side). Leaving a way at an end that meets exactly one other continues in that one; pointer
    jumping gives every state its distance to the run's far end and the least way up to there. A run is read from the end whose way is
    less; a ring is cut at its least way. A way that goes on nowhere is a run of its own and takes no part."""
    glued = settled((degree_two_links(ends) if links is None else links).select("way", "side", "w2", "s2"))
    # state (way, side): the walk leaves `way` by `side`; it goes on in w2 and leaves that by the other side
    step = glued.select("way", "side", F.col("w2").alias("nw"), (1 - F.col("s2")).alias("ns"))
    sides = glued.groupBy("way").agg(F.count("*").alias("n"), F.min("side").alias("side"))
    ended = sides.where("n = 1").select("way", (1 - F.col("side")).alias("side"), F.lit(0).alias("hops"), F.col("way").alias("last"), F.col("way").alias("low"))
    walked, rings = _walked(step, settled(ended), rounds)
    near = F.min(F.struct("last", "hops")).alias("e")
    met = walked.groupBy("way").agg(near, F.min("low").alias("run"), F.count("*").alias("n"))
    found = met.where("n = 2").select("way", "run", F.col("e.hops").alias("pos"))
    if not rings.isEmpty():
        # the walk never enters the least way again; the way at which it ends is the ring's second one
        states = step.join(rings, ["way", "side"]).withColumn("nw", F.when(F.col("nw") != F.col("run"), F.col("nw")))
        start = states.where("nw is null").select("way", "side", F.lit(0).alias("hops"), F.col("way").alias("last"), F.col("way").alias("low"))
        cut = _walked(states.where("nw is not null").select("way", "side", "nw", "ns"), settled(start), rounds)[0].join(rings, ["way", "side"])
        first = cut.where("way = run and side = 0").select("run", F.col("last").alias("start"))
        toward = cut.where("way <> run").join(first, "run").where("last = start").groupBy("way", "run").agg((F.min("hops") + 1).alias("pos"))
        found = found.unionByName(toward).unionByName(rings.where("way = run").select("way", "run", F.lit(0).alias("pos")).distinct())
    alone = ends.select("way").join(glued.select("way").distinct(), "way", "left_anti")
    return found.unionByName(alone.select("way", F.col("way").alias("run"), F.lit(0).alias("pos")))


def _walked(step: DataFrame, ended: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """States (way, side) that go on in (nw, ns), and those that are ended (hops 0, last and low the way itself): each with the hops to
    the last way of its walk and the least way met (way, side, hops, last, low); and states of rings (way, side, run), whose walks
    never end.

    A round doubles the steps that open states have gone, and states that come to an end stay out of it. Of an open walk, a state
    comes to its end in every round, so where none does, rings are left. There the least way is known when a round changes none."""
    state = ["way", "side", "hops", "last", "low"]
    going = settled(step.select("way", "side", "nw", "ns", F.lit(1).alias("hops"), F.least("way", "nw").alias("low")))
    done, many = [ended], going.count()
    for _ in range(rounds):
        if not many:
            return union_all(done), going.select("way", "side", F.col("low").alias("run"))
        blank = F.lit(None).cast(going.schema["nw"].dataType)
        ahead = union_all(done).select("way", "side", "hops", "last", "low", blank.alias("fw"), F.lit(None).cast("int").alias("fs"))
        ahead = ahead.unionByName(going.select("way", "side", "hops", blank.alias("last"), "low", F.col("nw").alias("fw"), F.col("ns").cast("int").alias("fs")))
        ahead = ahead.select(F.col("way").alias("nw"), F.col("side").alias("ns"), F.col("hops").alias("more"), "last", F.col("low").alias("low2"), "fw", "fs")
        met = going.join(ahead, ["nw", "ns"]).select("way", "side", F.col("fw").alias("nw"), F.col("fs").alias("ns"), (F.col("hops") + F.col("more")).alias("hops"), "last", F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("less"))
        met = settled(met)
        done.append(met.where("nw is null").select(*state))
        going, was = met.where("nw is not null").select("way", "side", "nw", "ns", "hops", "low"), many
        many = met.where("nw is not null").count()
        if many == was and met.where("less").isEmpty():
            return union_all(done), going.select("way", "side", F.col("low").alias("run"))
    raise RuntimeError("chains: not settled")


def reachable(edges: DataFrame, roots: DataFrame, rounds: int = 1000) -> DataFrame:
    """Nodes that directed edges (a, b) lead to from roots (id), with the least number of steps: (id, depth)."""
    found = settled(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    last = found
    for depth in range(1, rounds):
        nxt = last.select(F.col("id").alias("a")).join(edges, "a").select(F.col("b").alias("id")).distinct().join(found, "id", "left_anti").withColumn("depth", F.lit(depth))
        last = settled(nxt)
        if last.isEmpty():
            return found
        found = settled(found.unionByName(last))
    raise RuntimeError("reachable: not settled")


def reachable_from_itself(edges: DataFrame) -> DataFrame:
    """Nodes (id) on a cycle of directed edges (a, b); null ends are no edges, a = b is a cycle of one.

    Nodes that nothing leads to, or that lead to nothing, go. Nodes with one way in and one way out are strung to one edge by
    pointer jumping, whatever the chain's length, and remember that edge; a ring of such nodes alone is a cycle. Both make room for
    each other. What then remains is a knot: the greatest id that leads to each node is its colour, what a colour's own node
    can be reached from within the colour is a component, and components go. No pairs of a cycle are ever written; rounds grow with
    the logarithm of chains and the steps through a knot's junctions."""
    left = settled(edges.select("a", "b").where("a is not null and b is not null").distinct())
    ids = left.select(F.col("a").alias("id")).schema
    held = left.sparkSession.createDataFrame([], "id long, a long, b long").select(*[F.col(c).cast(ids["id"].dataType) for c in ("id", "a", "b")])
    found, knots = [], []
    while True:
        found.append(left.where("a = b").select(F.col("a").alias("id")))
        led = left.where("a <> b").select(F.col("b").alias("id")).intersect(left.where("a <> b").select(F.col("a").alias("id")))
        inner = settled(left.where("a <> b").join(led, F.col("a") == F.col("id"), "left_semi").join(led, F.col("b") == F.col("id"), "left_semi"))
        if inner.isEmpty():
            break
        one = inner.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"), F.min("b").alias("t")).where("n = 1").select("id", "t")
        one = settled(one.join(inner.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n"), F.min("a").alias("h")).where("n = 1").select("id", "h"), "id"))
        if one.isEmpty() and inner.count() == left.count():
            knot = _knots(inner)
            knots.append(knot)
            gone = knot.select("id")
            left = settled(inner.join(gone, F.col("a") == F.col("id"), "left_anti").join(gone, F.col("b") == F.col("id"), "left_anti"))
            continue
        strung, rings = _strung(one)
        found.append(rings)
        put = lambda df: _moved_ends(df.join(rings, F.col("a") == rings["id"], "left_anti"), strung)
        own = strung.select("id", F.col("h").alias("a"), F.col("t").alias("b"))
        of_rings = held.join(rings.select(F.col("id").alias("a")), "a", "left_semi").join(rings.select(F.col("id").alias("b")), "b", "left_semi").select("id")
        found.append(of_rings)
        held = settled(put(held).unionByName(own))
        left = settled(put(inner).distinct())
    found.append(held.where("a = b").select("id"))
    if knots:
        label = reduce(DataFrame.unionByName, knots)
        found.append(label.where("several").select("id"))
        end = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
        found.append(held.join(end("a"), "a").join(end("b"), "b").where("_a = _b").select("id"))
    return settled(reduce(DataFrame.unionByName, found).distinct())


def _strung(one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, h, t) with one node before and one behind: each with the first nodes that are none of them, and those that only lead
    round to each other (id). After n doublings a pointer is 2^n steps on, so what hasn't come to an end then never does."""
    inside = one.select(F.col("id").alias("_id"))
    at = one.select("id", "h", "t")
    for _ in range(one.count().bit_length() + 1):
        far = lambda c: at.select(F.col("id").alias(c), F.col(c).alias(f"_{c}"))
        after = settled(at.join(far("h"), "h", "left").join(far("t"), "t", "left").select("id", F.coalesce("_h", "h").alias("h"), F.coalesce("_t", "t").alias("t")))
        open_ = after.join(inside, F.col("t") == F.col("_id"), "left_semi")
        at = after
        if open_.isEmpty():
            break
    rings = settled(at.join(inside, F.col("t") == F.col("_id"), "left_semi").select("id"))
    return settled(at.join(rings, "id", "left_anti")), rings


def _moved_ends(df: DataFrame, strung: DataFrame) -> DataFrame:
    """Edges (a, b and more) with ends inside chains moved to the chains' ends."""
    heads, tails = strung.select(F.col("id").alias("a"), "h"), strung.select(F.col("id").alias("b"), "t")
    moved = df.join(heads, "a", "left").join(tails, "b", "left")
    return moved.select(*[F.coalesce("h", "a").alias("a") if c == "a" else F.coalesce("t", "b").alias("b") if c == "b" else F.col(c) for c in df.columns])


def _knots(edges: DataFrame) -> DataFrame:
    """One layer of strongly connected components of edges (a, b) without loops: id, component, several (has more than one node)."""
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    colour = settled(nodes.withColumn("c", F.col("id")))
    while True:
        near = edges.join(colour.select(F.col("id").alias("a"), F.col("c").alias("n")), "a").groupBy(F.col("b").alias("id")).agg(F.max("n").alias("n"))
        after = settled(colour.join(near, "id", "left").select("id", F.greatest("c", "n").alias("c"), (F.coalesce("n", "c") > F.col("c")).alias("new")))
        colour = after.select("id", "c")
        if after.where("new").isEmpty():
            break
    own = lambda e: colour.select(F.col("id").alias(e), F.col("c").alias(f"c{e}"))
    within = settled(edges.join(own("a"), "a").join(own("b"), "b").where("ca = cb").select("a", "b"))
    reached = settled(colour.where("id = c"))
    front = reached
    while True:
        step = within.join(front.select(F.col("id").alias("b"), "c"), "b").select(F.col("a").alias("id"), "c").distinct()
        front = settled(step.join(reached, "id", "left_anti"))
        if front.isEmpty():
            break
        reached = settled(reached.unionByName(front))
    size = reached.groupBy("c").agg((F.count("*") > 1).alias("several"))
    return settled(reached.join(size, "c").select("id", F.col("c").alias("component"), "several"))


def generalized(points: DataFrame, tolerance: float, track: str = "track_id", rounds: int = 64, protected: str | None = None) -> DataFrame:
    """Line generalisation: of each open span the inner vertex farthest from the line through the span's ends is kept if it is
    farther than the tolerance, and splits the span. All lines' spans are split at once, one level of the recursion a round.
    points: track, pos, x, y; the kept (track, pos).

    A closed line (its last vertex is its first one, of more than three) starts as two spans, split at the vertex farthest from
    its first one; where fewer than three vertices besides the closing one would be left, the ring stays as it is. protected: a
    column of vertices that are kept and split from the start. A vertex carries its span's ends, and a split reaches it by
    (track, start): no vertex meets another span. A tolerance of 0 or less keeps all."""
    if tolerance <= 0:
        return points.select(track, "pos")
    by = Window.partitionBy(track)
    here = F.struct("pos", "x", "y")
    whole = points.select(track, "pos", "x", "y", (F.coalesce(F.col(protected), F.lit(False)) if protected else F.lit(False)).alias("_p"))
    whole = whole.withColumns({"i": F.min_by(here, "pos").over(by), "j": F.max_by(here, "pos").over(by), "n": F.count("*").over(by)})
    ring = (F.col("n") > 3) & (F.col("i.x") == F.col("j.x")) & (F.col("i.y") == F.col("j.y"))
    edge = (F.col("pos") == F.col("i.pos")) | (F.col("pos") == F.col("j.pos"))
    out = F.when(ring & ~edge, F.struct(F.hypot(F.col("x") - F.col("i.x"), F.col("y") - F.col("i.y")).alias("d"), (-F.col("pos")).alias("p")))
    whole = settled(whole.withColumns({"ring": ring, "edge": edge, "far": F.max(out).over(by)}))
    fixed = F.col("edge") | F.col("_p") | (F.col("ring") & (F.col("pos") == -F.col("far.p")))
    order = by.orderBy("pos")
    bounds = {"i": F.last(F.when(fixed, here), True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "j": F.first(F.when(fixed, here), True).over(order.rowsBetween(0, Window.unboundedFollowing))}
    started = settled(whole.withColumns(bounds).withColumn("fixed", fixed).select(track, "pos", "x", "y", "i", "j", "fixed"))
    kept = started.where("fixed").select(track, "pos")
    inner = started.where("not fixed").drop("fixed")
    for _ in range(rounds):
        d = line_distance("x", "y", "i.x", "i.y", "j.x", "j.y")
        far = inner.groupBy(track, F.col("i.pos").alias("_i")).agg(F.max(F.struct(d.alias("d"), (-F.col("pos")).alias("p"), here.alias("k"))).alias("m"))
        split = settled(far.where(F.col("m.d") > tolerance).select(track, "_i", "m.k"))
        if split.isEmpty():
            break
        kept = settled(kept.unionByName(split.select(track, F.col("k.pos").alias("pos"))))
        met = inner.withColumn("_i", F.col("i.pos")).join(split, [track, "_i"])
        left = F.col("pos") < F.col("k.pos")
        inner = settled(met.where(F.col("pos") != F.col("k.pos")).select(track, "pos", "x", "y", F.when(left, F.col("i")).otherwise(F.col("k")).alias("i"), F.when(left, F.col("k")).otherwise(F.col("j")).alias("j")))
    else:
        raise RuntimeError("generalized: not settled")
    kept = kept.distinct()
    few = kept.groupBy(track).agg(F.count("*").alias("n")).where("n < 4").join(whole.where("ring").select(track).distinct(), track, "left_semi").select(track)
    return kept.join(few, track, "left_anti").unionByName(whole.join(few, track, "left_semi").select(track, "pos"))


def oriented(members: DataFrame, snaps: DataFrame, limit: float) -> DataFrame:
    """Direction of each way of an ordered relation (relation, pos, way, a, b, xa, ya, xb, yb): forward where it starts at the
    node where the one before ended, reverse where it ends there. Where they share no node, an allowlisted pair (before, way)
    whose ends are within the limit is snapped; anything else is a break, after which the way goes forward, or as its
    follower wants. relation, pos, way, direction, join: start, node, snap or break.

    A direction depends on the one before: a relation's members stream by in order with the end reached so far."""
    order = Window.partitionBy("relation").orderBy("pos")
    paired = members.withColumns({"before": F.lag("way").over(order), "na": F.lead("a").over(order), "nb": F.lead("b").over(order)})
    paired = paired.join(snaps.select("before", "way", F.lit(True).alias("allowed")).distinct(), ["before", "way"], "left")
    number = [F.col(c).cast("double").alias(c) for c in ("xa", "ya", "xb", "yb")]
    rows = paired.select("relation", F.col("pos").cast("bigint").alias("pos"), F.col("way").cast("bigint").alias("way"), "a", "b", *number, "allowed", "na", "nb")

    def step(state, row):
        relation, pos, way, a, b, xa, ya, xb, yb, allowed, na, nb = row
        end, x, y, first = state
        if first:
            join = "start"
        elif end in (a, b):
            join = "node"
        else:
            da, db = math.hypot(x - xa, y - ya), math.hypot(x - xb, y - yb)
            join = "snap" if allowed and min(da, db) <= limit else "break"
        follows = {n for n in (na, nb) if n is not None}
        back = end != a if join == "node" else db < da if join == "snap" else b not in follows and a in follows
        state[:] = [a, xa, ya, False] if back else [b, xb, yb, False]
        return ((relation, pos, way, "reverse" if back else "forward", join),)

    kind = members.schema["relation"].dataType.simpleString()
    return folded(rows, ["relation"], ["pos", "way"], lambda row: [None, 0.0, 0.0, True], step, f"relation {kind}, pos bigint, way bigint, direction string, join string")


def merged_lines(lines: DataFrame) -> DataFrame:
    """Lines (line, points: an array of struct(x, y)) merged at equal ends where exactly two meet: run, lines, points in order.

    Lines that are equal in either direction, or have no length, count once or not at all. A merged line's points are one
    array, as each input line's are."""
    key = lambda q: F.concat_ws(" ", q["x"], q["y"])
    back = F.reverse("points")
    one = lines.where(F.size(F.array_distinct("points")) > 1).select("line", F.when(F.col("points") <= back, F.col("points")).otherwise(back).alias("points"))
    one = settled(one.groupBy("points").agg(F.min("line").alias("way")))
    ends = one.select("way", key(F.element_at("points", 1)).alias("a"), key(F.element_at("points", -1)).alias("b"))
    placed = chains(ends).join(one, "way").join(ends, "way")
    by = Window.partitionBy("run").orderBy("pos")
    after, before = F.lead(F.array("a", "b")).over(by), F.lag(F.array("a", "b")).over(by)
    both = F.array_contains(before, F.col("a")) & F.array_contains(before, F.col("b"))  # a ring of two
    last = F.when(both, F.lag("b").over(by) != F.col("a")).otherwise(~F.array_contains(before, F.col("a")))
    turned = F.when(after.isNotNull(), ~F.array_contains(after, F.col("b"))).when(before.isNotNull(), last).otherwise(False)
    rows = placed.withColumn("g", F.when(turned, F.reverse("points")).otherwise(F.col("points")))
    packed = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("pos", "g"))).alias("p"), F.count("*").alias("lines"))
    join = lambda acc, x: F.concat(acc, F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == F.element_at(x["g"], 1)), F.slice(x["g"], 2, F.size(x["g"]))).otherwise(x["g"]))
    kind = lines.schema["points"].dataType.simpleString()
    return packed.select("run", "lines", F.aggregate("p", F.array().cast(kind), join).alias("points"))


def _walk(ways: list[tuple], by_ends: bool, roles: bool) -> list[int] | None:
    """Order of all ways (way, a, b, role), each beginning where the one before ended: in the given order, or led by their ends,
    of which exactly two meet everywhere. roles: forward and backward ways are walked that way only."""
    allowed = lambda role: [False] if roles and role == "forward" else [True] if roles and role == "backward" else [False, True]
    meet: dict = {}
    for i, (_, a, b, _) in enumerate(ways):
        meet.setdefault(a, []).append(i)
        meet.setdefault(b, []).append(i)
    if by_ends and any(len(x) != 2 for x in meet.values()):
        return None
    for back in allowed(ways[0][3]):
        order, start, at = [0], *((ways[0][2], ways[0][1]) if back else (ways[0][1], ways[0][2]))
        while len(order) < len(ways):
            seen = set(order)
            ahead = [i for i in dict.fromkeys(meet.get(at, [])) if i not in seen] if by_ends else [len(order)]
            if len(ahead) != 1:
                break
            _, a, b, role = ways[ahead[0]]
            turn = next((t for t in allowed(role) if (b if t else a) == at), None)
            if turn is None:
                break
            order.append(ahead[0])
            at = a if turn else b
        if len(order) == len(ways):
            return [*order, -1 if start == at else -2]
    return None


def _lap(ways: list[tuple]) -> tuple[list, bool, str, list[str]]:
    """Ways in walking order, whether they close, the method and what was found on the way."""
    conflict = "roles conflict with ends"
    for roles in (True, False):
        for by_ends, method in ((False, "order"), (True, "cycle")):
            found = _walk(ways, by_ends, roles)
            if found:
                return [ways[i][0] for i in found[:-1]], found[-1] == -1, method + ("" if roles else "-role-relaxed"), [] if roles else [conflict]
    left = ways
    while True:
        ends = [e for _, a, b, _ in left for e in (a, b)]
        kept = [w for w in left if ends.count(w[1]) > 1 and ends.count(w[2]) > 1]
        if len(kept) == len(left):
            break
        left = kept
    if left and len(left) < len(ways):
        for roles in (True, False):
            for by_ends, method in ((False, "order"), (True, "cycle")):
                found = _walk(left, by_ends, roles)
                if found and found[-1] == -1:
                    gone = "pruned " + ",".join(sorted(str(w[0]) for w in ways if w not in left))
                    return [left[i][0] for i in found[:-1]], True, f"pruned-{method}" + ("" if roles else "-role-relaxed"), [gone] + ([] if roles else [conflict])
    return [ways[0][0]], False, "unresolved", ["ways form no single closed walk"]


def laps(members: DataFrame) -> DataFrame:
    """Laps of ordered member ways (relation, pos, way, a, b, role): relation, ways in walking order, closed, method, findings.

    Tried in turn: the given order, ways led by their ends where exactly two meet, both without regard to roles, and all four
    on what is left when ways with a loose end are pruned again and again. Else the first way stands alone, unresolved. A
    relation's members are one small group of a task, held while they stream by; relations are dealt out by Spark. Ways without ends are
    left out."""
    way = members.schema["way"].dataType.simpleString()
    relation = members.schema["relation"].dataType.simpleString()

    def start(row):
        return [row[0], []]

    def step(state, row):
        state[1].append(row[2:])
        return ()

    def finish(state):
        return [(state[0], *_lap(state[1]))]

    whole = members.where("a is not null and b is not null").select("relation", "pos", "way", "a", "b", F.coalesce("role", F.lit("")).alias("role"))
    return folded(whole, ["relation"], ["pos", "way", "a", "b", "role"], start, step, f"relation {relation}, ways array<{way}>, closed boolean, method string, findings array<string>", finish)
