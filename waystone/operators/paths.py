"""Shortest routes as ordered edges: chains of degree-two nodes contracted, all queries at once, equal routes enumerated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waystone.operators.graph import chains, components, degree_two_links
from waystone.operators.nets import solved
from waystone.operators.storage import removed, settled, union_all


def contracted(edges: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (edge, a, b, m) with the nodes at which exactly two of them meet taken out, but for those of `ends` (id).

    Two tables: hops (run, s, t, m, lead, tail) between what is left, lead and tail being the edges at s and t, and members (run,
    pos, edge, u, v, m), the run's edges from s to t. Pointer jumping makes a chain of any length one hop in few rounds. A ring
    that comes back to its start is no part of a shortest route and is left out."""
    own = settled(edges.where("a <> b and m is not null").select(F.col("edge").alias("way"), "a", "b", F.col("m").cast("double").alias("m")))
    held = ends.select("id").distinct()
    links = degree_two_links(own.select("way", "a", "b"), held)
    placed = chains(own.select("way", "a", "b"), links=links).join(own, "way")
    by = Window.partitionBy("run").orderBy("pos")
    after, before = F.lead(F.array("a", "b")).over(by), F.lag(F.array("a", "b")).over(by)
    turned = F.when(after.isNotNull(), ~F.array_contains(after, F.col("b"))).when(before.isNotNull(), ~F.array_contains(before, F.col("a"))).otherwise(False)
    u, v = F.when(F.col("_t"), F.col("b")).otherwise(F.col("a")), F.when(F.col("_t"), F.col("a")).otherwise(F.col("b"))
    members = settled(placed.withColumn("_t", turned).select("run", "pos", F.col("way").alias("edge"), u.alias("u"), v.alias("v"), "m"))
    runs = members.groupBy("run").agg(F.min_by(F.struct("u", "edge"), "pos").alias("f"), F.max_by(F.struct("v", "edge"), "pos").alias("l"), F.sum("m").alias("m"))
    hops = runs.select("run", F.col("f.u").alias("s"), F.col("l.v").alias("t"), "m", F.col("f.edge").alias("lead"), F.col("l.edge").alias("tail"))
    removed(own)
    return settled(hops.where("s <> t")), members


def _distances(steps: DataFrame, pairs: DataFrame, tolerance: float, rounds: int) -> DataFrame:
    """(query, node, d) of nodes no farther from a query's source than its target is, over steps (s, t, m). A round extends only the
    nodes that came nearer in the round before."""
    light = steps.groupBy("s", "t").agg(F.min("m").alias("m"))
    goal = pairs.select("query", F.col("target").alias("node"))
    best = settled(pairs.select("query", F.col("source").alias("node"), F.lit(0.0).alias("d")))
    front = best
    for _ in range(rounds):
        reached = best.join(goal, ["query", "node"]).select("query", F.col("d").alias("most"))
        ahead = front.join(light, F.col("node") == F.col("s")).groupBy("query", F.col("t").alias("node")).agg(F.min(F.col("d") + F.col("m")).alias("d"))
        ahead = ahead.join(reached, "query", "left").where(F.col("most").isNull() | (F.col("d") <= F.col("most") + tolerance)).select("query", "node", "d")
        met = ahead.join(best.withColumnRenamed("d", "old"), ["query", "node"], "left")
        nearer = settled(met.where(F.col("old").isNull() | (F.col("d") < F.col("old") - tolerance)).select("query", "node", "d"))
        if front is not best:
            removed(front)
        front = nearer
        if front.isEmpty():
            removed(front)
            return best
        more = settled(best.unionByName(front).groupBy("query", "node").agg(F.min("d").alias("d")))
        removed(best)
        best = more
    raise RuntimeError("shortest_routes: not settled")


#: Nets of at most so many nodes, and of so many edges and pairs, are solved whole in a task.
WHOLE_NODES, WHOLE_ROWS = 64, 4096


def shortest_routes(edges: DataFrame, pairs: DataFrame, limit: int = 4, tolerance: float = 1e-6, rounds: int = 10_000, whole: int = WHOLE_NODES) -> tuple[DataFrame, DataFrame]:
    """The shortest routes of pairs (query, source, target) over undirected edges (edge, a, b, m), m above 0.

    Two tables: found (query, m, paths, exhaustive), m null and paths 0 where the target isn't reached, paths the number of routes
    whose length is the least within the tolerance, exhaustive whether no more than `limit` of them; and routes (query, path, seq,
    edge, u, v, m): the edges of the first `limit` of them in order. Routes are numbered from 1 in the order of their edges, edge
    by edge where they part. Parallel edges are different routes; a source that is its target is reached by a route without edges.

    Connected nets of up to `whole` nodes are solved by the task that holds them, so a query costs its row; larger ones by rounds of joins."""
    found, routes = _routes(edges, pairs, limit, tolerance, rounds, whole, True)
    return found, routes.drop("paths")


def _routes(edges: DataFrame, pairs: DataFrame, limit: int, tolerance: float, rounds: int, whole: int, listed: bool) -> tuple[DataFrame, DataFrame | None]:
    """shortest_routes(), its routes with the number of their query's (paths), or found alone."""
    pairs = settled(pairs.where("source is not null and target is not null").select("query", "source", "target"))
    own = settled(edges.where("a <> b and m is not null").select("edge", "a", "b", F.col("m").cast("double").alias("m")))
    home = components(own.select("a", "b"))
    e = own.join(home.withColumnRenamed("id", "a"), "a").select("component", F.struct("edge", "a", "b", "m").alias("e"))
    p = pairs.join(home.withColumnRenamed("id", "source"), "source", "left").select("component", F.struct("query", "source", "target").alias("p"))
    rows = settled(e.withColumn("p", F.lit(None).cast(p.schema["p"].dataType)).unionByName(p.withColumn("e", F.lit(None).cast(e.schema["e"].dataType))))
    sizes = rows.groupBy("component").agg(F.count("e").alias("edges"), F.count("p").alias("pairs"))
    large = home.groupBy("component").agg(F.count("*").alias("nodes")).join(sizes, "component")
    large = settled(large.where((F.col("pairs") > 0) & ((F.col("nodes") > whole) | (F.col("edges") > WHOLE_ROWS) | (F.col("pairs") > WHOLE_ROWS))).select("component"))
    beyond = not large.isEmpty()
    small = rows.join(large, "component", "left_anti") if beyond else rows
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as few bytes hold much work
    nets = small.where("component is not null").repartition(parts, "component").groupBy("component").agg(F.collect_list("e").alias("edges"), F.collect_list("p").alias("pairs")).where(F.size("pairs") > 0)
    inside = settled(solved(nets, limit, tolerance, listed))
    same = F.col("p.source") == F.col("p.target")
    lone = rows.where("component is null").select("p.query", F.when(same, 0.0).alias("m"), F.when(same, 1).otherwise(0).cast("long").alias("paths"))
    found = inside.select("query", "m", "paths").unionByName(lone)
    routes = inside.select("query", "paths", F.inline("routes")) if listed else None
    if beyond:
        out = rows.join(large, "component", "left_semi")
        more, further = _routes_by_rounds(out.where("e is not null").select("e.*"), out.where("p is not null").select("p.*"), limit, tolerance, rounds, listed)
        found = found.unionByName(more)
        if listed:
            routes = routes.unionByName(further.join(more.select("query", "paths"), "query"))
    return found.withColumn("exhaustive", F.col("paths") <= limit), routes


def _routes_by_rounds(edges: DataFrame, pairs: DataFrame, limit: int, tolerance: float, rounds: int, listed: bool) -> tuple[DataFrame, DataFrame | None]:
    """found (query, m, paths) and routes of shortest_routes() over nets of any size.

    Steps on some shortest route are found from the target backwards and form an acyclic graph, in which routes are counted and
    then extended from the source; of routes that are alike in length so far only the first `limit` go on, as no later one can
    come before them."""
    pairs = settled(pairs)
    ends = pairs.select(F.col("source").alias("id")).unionByName(pairs.select(F.col("target").alias("id")))
    hops, members = contracted(edges, ends)
    steps = settled(hops.select("run", "s", "t", "m", F.lit(True).alias("on"), F.col("lead").alias("first")).unionByName(hops.select("run", F.col("t").alias("s"), F.col("s").alias("t"), "m", F.lit(False).alias("on"), F.col("tail").alias("first"))))
    best = _distances(steps, pairs, tolerance, rounds)
    goal, home = pairs.select("query", F.col("target").alias("node")), pairs.select("query", F.col("source").alias("node"))
    at = settled(best.join(goal, ["query", "node"]).select("query", "node", "d", F.lit(1).cast("long").alias("n")))
    dag, homes = [], [at.join(home, ["query", "node"], "left_semi").select("query", "n")]
    for _ in range(rounds):
        back = at.join(steps, F.col("node") == F.col("t")).select("query", F.col("s").alias("node"), "t", "run", "on", "first", (F.col("d") - F.col("m")).alias("want"), "n")
        tight = settled(back.join(best, ["query", "node"]).where(F.abs(F.col("d") - F.col("want")) <= tolerance).select("query", "node", "t", "run", "on", "first", "d", "n"))
        if tight.isEmpty():
            break
        dag.append(tight.select("query", F.col("node").alias("s"), "t", "run", "on", "first"))
        at = settled(tight.groupBy("query", "node").agg(F.sum("n").alias("n"), F.first("d").alias("d")).select("query", "node", "d", "n"))
        homes.append(at.join(home, ["query", "node"], "left_semi").select("query", "n"))
    else:
        raise RuntimeError("shortest_routes: routes not counted")
    total = union_all(homes).groupBy("query").agg(F.sum("n").alias("paths"))
    reached = best.join(goal, ["query", "node"]).select("query", "d")
    count = F.coalesce("paths", F.lit(0).cast("long"))
    found = settled(pairs.select("query").join(reached, "query", "left").join(total, "query", "left").select("query", F.col("d").alias("m"), count.alias("paths")))
    if not listed:
        return found, None
    routes = _enumerated(pairs, union_all(dag).distinct() if dag else None, limit, rounds)
    return found, settled(_expanded(routes, members)) if routes is not None else members.sparkSession.createDataFrame([], _route_schema(pairs, members))


def _route_schema(pairs: DataFrame, members: DataFrame) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"query {kind(pairs, 'query')}, path int, seq int, edge {kind(members, 'edge')}, u {kind(members, 'u')}, v {kind(members, 'v')}, m double"


def _enumerated(pairs: DataFrame, dag: DataFrame | None, limit: int, rounds: int) -> DataFrame | None:
    """The first `limit` routes of each query: (query, path, steps: array of struct(first, run, on))."""
    if dag is None:
        return None
    step = F.struct("first", "run", "on")
    dag = settled(dag.select("query", F.col("s").alias("node"), "t", step.alias("step")))
    front = settled(pairs.where("source <> target").select("query", F.col("source").alias("node"), F.col("target").alias("goal"), F.array().cast(f"array<{dag.schema['step'].dataType.simpleString()}>").alias("steps")))
    done: list[DataFrame] = []
    for _ in range(rounds):
        longer = front.join(dag, ["query", "node"]).select("query", F.col("t").alias("node"), "goal", F.concat("steps", F.array("step")).alias("steps"))
        place = F.row_number().over(Window.partitionBy("query").orderBy("steps"))
        after = settled(longer.withColumn("_r", place).where(F.col("_r") <= limit).drop("_r"))
        removed(front)
        if after.isEmpty():
            break
        done.append(after.where("node = goal").select("query", "steps"))
        front = settled(after.where("node <> goal"))
    else:
        raise RuntimeError("shortest_routes: routes not listed")
    place = F.row_number().over(Window.partitionBy("query").orderBy("steps"))
    return union_all(done).withColumn("path", place).where(F.col("path") <= limit)


def _expanded(routes: DataFrame, members: DataFrame) -> DataFrame:
    """Edges of routes (query, path, steps) in order, each in the direction of travel."""
    flat = routes.select("query", "path", F.posexplode("steps").alias("hop", "s")).select("query", "path", "hop", "s.run", "s.on")
    met = flat.join(members, "run")
    along = F.when(F.col("on"), F.col("pos")).otherwise(-F.col("pos"))
    seq = F.row_number().over(Window.partitionBy("query", "path").orderBy("hop", along))
    u, v = F.when(F.col("on"), F.col("u")).otherwise(F.col("v")), F.when(F.col("on"), F.col("v")).otherwise(F.col("u"))
    return met.select("query", F.col("path").cast("int").alias("path"), seq.alias("seq"), "edge", u.alias("u"), v.alias("v"), "m")


def corridor(edges: DataFrame, legs: DataFrame, limit: int = 4) -> tuple[DataFrame, DataFrame]:
    """Corridors of legs (corridor, leg, source, target) over edges (edge, a, b, m): told (corridor, leg, m, paths, status) and
    routes (corridor, leg, seq, edge, u, v, m).

    status: no-path, ambiguous (several shortest routes), repeat (an edge of this leg is one of an earlier leg's of its corridor), else
    accepted. Only accepted legs and repeats have a route."""
    keyed = settled(legs.select("corridor", "leg", F.struct("corridor", "leg").alias("query"), "source", "target"))
    found, routes = _routes(edges, keyed, limit, 1e-6, 10_000, WHOLE_NODES, True)
    one = routes.where("paths = 1").select("query.corridor", "query.leg", "seq", "edge", "u", "v", "m")
    earlier = F.min("leg").over(Window.partitionBy("corridor", "edge")) < F.col("leg")
    again = one.withColumn("_again", earlier).groupBy("corridor", "leg").agg(F.max("_again").alias("repeats"))
    met = keyed.join(found, "query", "left").join(again, ["corridor", "leg"], "left")
    status = F.when(F.col("m").isNull(), "no-path").when(F.col("paths") > 1, "ambiguous").when(F.col("repeats"), "repeat").otherwise("accepted")
    return met.select("corridor", "leg", "m", F.coalesce("paths", F.lit(0).cast("long")).alias("paths"), status.alias("status")), one


def one_of_parallel(edges: DataFrame) -> DataFrame:
    """Of edges (edge, a, b, m) between the same nodes the shortest one (ties: least edge), whichever way they are drawn."""
    best = F.min(F.struct("m", "edge", F.struct("a", "b").alias("e"))).alias("x")
    one = edges.groupBy(F.least("a", "b").alias("_p"), F.greatest("a", "b").alias("_q")).agg(best)
    return one.select("x.edge", "x.e.a", "x.e.b", "x.m")


def corridor_legs(edges: DataFrame, nodes: DataFrame, legs: DataFrame, detour: float, snap: float) -> DataFrame:
    """Legs (query, sx, sy, tx, ty) between anchors over edges (edge, a, b, m) of nodes (id, x, y): each anchor goes to the nearest node
    within `snap` (ties: least id); m is the shortest way between them, paths how many are as short, and status: accepted,
    no-anchor, no-path, ambiguous (several shortest) or detour (m above `detour` times the straight line).

    Nodes and anchors at one place are one, of nodes the least; legs between the same two nodes are one question."""
    cell = lambda c: F.floor(F.col(c) / snap)
    held = nodes.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))

    def anchored(x: str, y: str, name: str) -> DataFrame:
        around = F.array(*[F.struct((cell(x) + i).alias("cx"), (cell(y) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        spread = legs.select(x, y).distinct().select(F.col(x).alias("ax"), F.col(y).alias("ay"), F.explode(around).alias("c")).select("ax", "ay", "c.cx", "c.cy")
        d = F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))
        return spread.join(held, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= snap).groupBy(F.col("ax").alias(x), F.col("ay").alias(y)).agg(F.min(F.struct("d", "id"))["id"].alias(name))

    placed = settled(legs.join(anchored("sx", "sy", "source"), ["sx", "sy"], "left").join(anchored("tx", "ty", "target"), ["tx", "ty"], "left"))
    asked = placed.where("source is not null and target is not null").select("source", "target").distinct()
    found = _routes(edges, asked.select(F.struct("source", "target").alias("query"), "source", "target"), 4, 1e-6, 10_000, WHOLE_NODES, False)[0]
    straight = F.hypot(F.col("sx") - F.col("tx"), F.col("sy") - F.col("ty"))
    met = placed.join(found.select("query.source", "query.target", "m", "paths"), ["source", "target"], "left")
    status = (
        F.when(F.col("source").isNull() | F.col("target").isNull(), "no-anchor").when(F.col("m").isNull(), "no-path").when(F.col("paths") > 1, "ambiguous")
        .when(F.col("m") > detour * straight, "detour").otherwise("accepted")
    )
    return met.select("query", "source", "target", "m", F.coalesce("paths", F.lit(0)).alias("paths"), status.alias("status"))
