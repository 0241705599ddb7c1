"""Ranked and budgeted selection per group."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone.operators.folds import folded
from waystone.operators.storage import settled, union_all

#: What sums of ink may be over a capacity by rounding.
INK_NOISE = 1e-9


def band(axis: Column, bands: int) -> Column:
    """Which of equal bands of [0, 1] a position is in."""
    return F.least(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), axis)) * bands), F.lit(bands - 1)).cast("int")


def top_of_each(df: DataFrame, partition: list[str], order: list, cap: int, name: str = "place") -> DataFrame:
    """The first `cap` rows of each group; the limit is applied before the exchange too."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(name) <= cap)


def distributed(df: DataFrame, partition: list[str], axis: Column, bands: int, score: list, most: int) -> DataFrame:
    """The best of each band first, in band order, then the rest by score, at most `most` a group. Adds band and place.

    score: columns that tell all candidates apart."""
    inside = df.withColumn("band", band(axis, bands)).withColumn("_first", F.row_number().over(Window.partitionBy(*partition, "band").orderBy(*score)) == 1)
    order = [F.desc("_first"), F.when(F.col("_first"), F.col("band")), *score]
    return top_of_each(inside, partition, order, most).drop("_first")


def round_robin(df: DataFrame, rank: str, tile: str, order: list) -> DataFrame:
    """Adds round: per rank, the n-th of each tile comes in round n (from 0). Sort by rank, round and tile."""
    return df.withColumn("round", F.row_number().over(Window.partitionBy(rank, tile).orderBy(*order)) - 1)


def within_budget(df: DataFrame, partition: list[str], key: str, size: str, budget: float | str, least: float, score: str | None = None) -> DataFrame:
    """Highest score (or longest) first, what doesn't fit is skipped and the next one tried; the first one is always kept.
    Returns the groups' keys of kept rows. budget: a number, or a column of df that each group has one value of.

    What is spent is always the size, whatever the score; equal scores go by the lesser key. A group's rows stream by in that
    order with what is spent so far, so a group of any size takes linear time."""
    limit = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    rows = df.where(F.col(size) >= least).select(*partition, F.col(key), (-F.col(score or size)).alias("_o"), F.col(size).cast("double").alias("_n"), limit.cast("double").alias("_limit"))
    return _fitting(rows, partition, key, ["_o", key, "_n"], ("_o",), lambda row: [0.0, True])


def _fitting(rows: DataFrame, partition: list[str], key: str, order: list[str], without: tuple[str, ...], start) -> DataFrame:
    """Keys of rows (partition, key, ... size, limit) that fit in order: state is what is spent and whether the next one is free."""

    def step(state, row):
        if row[-2] is not None and (state[1] or state[0] + row[-2] <= row[-1]):
            state[0] += row[-2]
            state[1] = False
            return (row[: len(partition) + 1],)
        return ()

    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*partition, key))
    return folded(rows, partition, order, start, step, ddl, without=without)


#: Page millimetres that a square millimetre of map may hold of each kind of detail, and the least length drawn.
DETAIL_DENSITY = {"local": 0.0715, "service": 0.0163, "path": 0.0358}
DETAIL_LEAST = {"local": 0.8, "service": 1.0, "path": 1.0}


def detail_score(category: Column, length: Column, distance: Column, half_diagonal: Column, named: Column, highway: Column, bridge: Column) -> Column:
    """How much a road detail is worth drawing: its length, up to a quarter more near the centre of the map, more with a name, for
    cycleways and pedestrian streets, and ten times on a bridge."""
    centrality = 1.25 - 0.25 * F.least(distance / F.greatest(half_diagonal, F.lit(1e-6)), F.lit(1.0))
    kind = F.when((category == "path") & highway.isin("cycleway", "pedestrian"), 1.20).otherwise(1.0)
    return length * centrality * F.when(named, 1.15).otherwise(1.0) * kind * F.when(bridge, 10.0).otherwise(1.0)


def detail_budget(groups: DataFrame, sheet: str, category: str, key: str, length: str, score: str, area_mm2: float) -> DataFrame:
    """Details kept of each sheet and category (local, service, path): by score, within a length that the map's area sets."""
    budget, least = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, density in DETAIL_DENSITY.items():
        budget = F.when(F.col(category) == name, density * area_mm2).otherwise(budget)
        least = F.when(F.col(category) == name, DETAIL_LEAST[name]).otherwise(least)
    known = groups.withColumns({"_budget": budget, "_least": least}).where(F.col(length) >= F.col("_least"))
    return within_budget(known, [sheet, category], key, length, "_budget", 0.0, score)


def cut_to_budget(df: DataFrame, partition: list[str], order: list, size: str, budget: float, protected: Column) -> DataFrame:
    """Drops whole rows, in the order given, until a group's sum is within budget; protected rows never go. Adds kept."""
    by = Window.partitionBy(*partition).orderBy(*order)  # one order for both sums, so that rows are sorted once
    total = F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gone = F.sum(F.when(protected, 0.0).otherwise(F.col(size))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("kept", protected | (total - F.coalesce(gone, F.lit(0.0)) <= budget))


def tier_quota(df: DataFrame, partition: list[str], tier: str, quota: int, order: list, most: int, required: Column) -> DataFrame:
    """Required rows first, then up to `quota` of each tier, then by order, at most `most` a group. Adds place."""
    inside = df.withColumn("_in", F.row_number().over(Window.partitionBy(*partition, tier).orderBy(*order)) <= quota).withColumn("_req", required)
    return top_of_each(inside, partition, [F.desc("_req"), F.desc("_in"), *order], most).drop("_in", "_req")


def filled(df: DataFrame, partition: list[str], key: str, order: Column, size: str, used: str, capacity: float) -> DataFrame:
    """Rows in order (a sortable column that tells them apart) that fit into what is left of a capacity; what doesn't fit is
    skipped. `used` holds what each group has spent already. A group of any size streams by in order."""
    rows = df.select(*partition, F.col(key), order.alias("_o"), F.col(used).cast("double").alias("_used"), F.col(size).cast("double").alias("_n"), F.lit(float(capacity)).alias("_limit"))
    return _fitting(rows, partition, key, ["_o"], ("_o",), lambda row: [row[-3], False])


def ink_selection(groups: DataFrame, plate: str, layer: str, key: str, rank: str, ink: str, capacity: float, reserve: float) -> DataFrame:
    """Which groups a plate's ink buys: each layer's reserve (a share of the capacity) is seeded with its largest groups
    first, then all other groups fill the rest by rank, then size, then key. Adds phase: reserve or fill.

    A layer's groups stream by and are told whether they are seeds; then a plate's do, seeds first, with what is spent so far."""
    limit = capacity * reserve
    kind = {c: groups.schema[c].dataType.simpleString() for c in (plate, layer, key, rank)}
    rows = groups.select(plate, layer, key, rank, F.col(ink).cast("double").alias("_n"), (-F.col(ink)).alias("_o"))

    def seed(state, row):
        size = row[4]
        seeded = size is not None and size >= 0.0 and (state[1] or state[0] + size <= limit)
        if seeded:
            state[0], state[1] = state[0] + size, False
        return ((row[0], row[2], row[3], size, seeded),)

    ddl = f"`{plate}` {kind[plate]}, `{key}` {kind[key]}, _rank {kind[rank]}, _n double, _seed boolean"
    told = folded(rows, [plate, layer], ["_o", key], lambda row: [0.0, True], seed, ddl, without=("_o",))

    def buy(state, row):
        _, name, size, seeded = row
        if not seeded and (size is None or state[0] + size > capacity):
            return ()
        state[0] += size
        return ((row[0], name, "reserve" if seeded else "fill"),)

    told = told.select(plate, key, "_n", "_seed", (-F.col("_rank")).alias("_r"), (-F.col("_n")).alias("_i"))
    return folded(told, [plate], [F.desc("_seed"), "_r", "_i", key], lambda row: [0.0], buy, f"`{plate}` {kind[plate]}, `{key}` {kind[key]}, phase string", without=("_r", "_i"))


def ink_phases(groups: DataFrame, plate: str, layer: str, key: str, ink: str, rank: str, tile: str, capacity: float, reserves: dict[str, float], roads: list[str], context: list[str]) -> DataFrame:
    """Which groups a plate's ink buys, in five phases under one capacity: plate, key, phase, ink. key tells a plate's groups apart.

    A layer's groups come by rank (least first), in rounds that take one of each tile, tiles in order, a tile's groups by key; all
    layers that are not named are one, the last. Groups that don't fit are passed over, and the next ones are tried.

    seed: each layer of `reserves`, in its order, gets its first group that leaves room for the smallest group of every later one.
    grow: each goes on to its reserve (or all its ink, if that is less), while what later ones can still claim stays free.
    road: the layers of `roads`, one after the other. context: always the layer that has least ink so far (ties: in order) is
    served next. late: the rest. Groups without ink given take no part.

    A plate's groups stream by in these orders, three times, with sums as their state; where one layer of the context waits for
    another, the keys and sizes of its groups are held until then."""
    named = list(dict.fromkeys([*reserves, *roads, *context]))
    lane = F.when(F.col(layer).isin(named), F.col(layer)).otherwise("")
    rows = groups.where(F.col(ink).isNotNull()).select(F.col(plate).alias("plate"), lane.alias("lane"), F.col(key).alias("key"), F.col(ink).cast("double").alias("ink"), F.col(rank).alias("rank"), F.col(tile).alias("tile"))
    rows = rows.withColumn("round", F.row_number().over(Window.partitionBy("plate", "lane", "rank", "tile").orderBy("key")))
    rows = settled(rows.withColumn("place", F.row_number().over(Window.partitionBy("plate", "lane").orderBy("rank", "round", "tile"))).select("plate", "lane", "key", "ink", "place"))
    at = lambda names: F.coalesce(*[F.when(F.col("lane") == name, i) for i, name in enumerate(names)], F.lit(None).cast("int"))
    key_type = rows.schema["key"].dataType.simpleString()
    ddl = f"plate {rows.schema['plate'].dataType.simpleString()}, key {key_type}, lane string, ink double"

    share = F.coalesce(*[F.when(F.col("lane") == name, float(most)) for name, most in reserves.items()], F.lit(0.0))
    fits = F.when(F.col("ink") <= capacity + INK_NOISE, F.col("ink"))
    facts = rows.where(F.col("lane").isin(list(reserves))).groupBy("plate", "lane").agg(F.sum("ink").alias("all"), F.min(fits).alias("least"), F.coalesce(F.sum(fits), F.lit(0.0)).alias("fit"))
    facts = facts.withColumns({"r": at(reserves), "asked": F.least("all", share)}).withColumn("claim", F.least("asked", "fit"))
    later = Window.partitionBy("plate").orderBy("r").rowsBetween(1, Window.unboundedFollowing)
    facts = settled(facts.withColumn("hold", F.coalesce(F.sum("least").over(later), F.lit(0.0))))

    def seed(state, row):
        owner, name, size, lane_, r, hold = row
        if r != state[1] and size <= max(0.0, capacity - state[0] - hold) + INK_NOISE:
            state[0], state[1] = state[0] + size, r
            return ((owner, name, lane_, size),)
        return ()

    first = rows.join(facts.select("plate", "lane", "r", "hold"), ["plate", "lane"]).select("plate", "key", "ink", "lane", "r", "hold", "place")
    seeds = settled(folded(first, ["plate"], ["r", "place"], lambda row: [0.0, None], seed, ddl, without=("place",)))

    def grow(state, row):
        owner, name, size, lane_, r, got, asked, hold, _ = row
        if r != state[1]:
            state[1:] = [r, max(0.0, capacity - state[0] - hold), got]
        if state[3] + INK_NOISE < asked and size <= state[2] + INK_NOISE:
            state[0], state[2], state[3] = state[0] + size, state[2] - size, state[3] + size
            return ((owner, name, lane_, size),)
        return ()

    given = facts.join(seeds.select("plate", "lane", F.col("ink").alias("got")), ["plate", "lane"], "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
    given = given.withColumn("hold", F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("claim") - F.col("got"))).over(later), F.lit(0.0)))
    given = given.withColumn("spent", F.sum("got").over(Window.partitionBy("plate"))).select("plate", "lane", "r", "got", "asked", "hold", "spent")
    more = rows.join(given, ["plate", "lane"]).join(seeds, ["plate", "key"], "left_anti").select("plate", "key", "ink", "lane", "r", "got", "asked", "hold", "spent", "place")
    grown = settled(folded(more, ["plate"], ["r", "place"], lambda row: [row[8], None, 0.0, 0.0], grow, ddl, without=("place",)))

    def fill(state, row):
        owner, name, size, lane_, phase, c, _, _, _ = row
        out, queues, have, left = [], state[1], state[2], state[3]
        room = lambda size: size <= max(0.0, capacity - state[0]) + INK_NOISE
        if phase != 1:
            if room(size):
                state[0] += size
                out.append((owner, name, lane_, size))
            return out
        queues[c].append((name, size))
        left[c] -= 1
        while waiting := [i for i in range(len(queues)) if queues[i] or left[i]]:
            i = min(waiting, key=lambda i: (have[i], i))
            if not queues[i]:
                break
            name, size = queues[i].popleft()
            if room(size):
                state[0] += size
                have[i] += size
                out.append((owner, name, context[i], size))
        return out

    bought = seeds.unionByName(grown)
    each = lambda value, kind: F.array(*[F.coalesce(value(F.when(F.col("lane") == name, F.col("ink"))).cast(kind), F.lit(0).cast(kind)) for name in context]).cast(f"array<{kind}>")
    sums = bought.groupBy("plate").agg(F.sum("ink").alias("spent"), each(F.sum, "double").alias("have"))
    rest = rows.join(bought, ["plate", "key"], "left_anti")
    counts = rest.groupBy("plate").agg(each(F.count, "bigint").alias("left"))
    phase = F.when(F.col("lane").isin(roads), 0).when(F.col("lane").isin(context), 1).otherwise(2)
    road, ctx = at(roads), F.coalesce(at(context), F.lit(0))
    rest = rest.join(sums, "plate", "left").join(counts, "plate").withColumns({"phase": phase, "c": ctx})
    o1 = F.when(F.col("phase") == 0, road).when(F.col("phase") == 1, F.col("place")).otherwise(0)
    o2 = F.when(F.col("phase") == 1, F.col("c")).otherwise(F.col("place"))
    ordered = rest.select("plate", "key", "ink", "lane", "phase", "c", F.coalesce("spent", F.lit(0.0)).alias("spent"), "have", "left", o1.alias("o1"), o2.alias("o2"))
    begin = lambda row: [row[6], [deque() for _ in context], list(row[7] or [0.0] * len(context)), list(row[8])]
    filled_ = folded(ordered, ["plate"], ["phase", "o1", "o2"], begin, fill, ddl, without=("o1", "o2"))
    named_phase = F.when(F.col("lane").isin(roads), "road").when(F.col("lane").isin(context), "context").otherwise("late")
    parts = [seeds.withColumn("phase", F.lit("seed")), grown.withColumn("phase", F.lit("grow")), filled_.withColumn("phase", named_phase)]
    return union_all([p.select(F.col("plate").alias(plate), F.col("key").alias(key), "phase", "ink") for p in parts])
