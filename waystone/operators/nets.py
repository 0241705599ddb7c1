"""Shortest routes inside small nets: a row is a net with its edges and pairs, and a task solves the nets of a batch together."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

#: Edges and pairs of nets that are solved at once.
AT_ONCE = 16_384


def solved(nets: DataFrame, limit: int, tolerance: float, listed: bool) -> DataFrame:
    """Nets (edges: array of struct(edge, a, b, m), pairs: array of struct(query, source, target)) to their pairs' query, m, paths and
    routes (array of struct(path, seq, edge, u, v, m)), by the rules of paths.shortest_routes(). Routes are empty unless listed."""
    from pyspark.sql.pandas.types import to_arrow_schema

    edge, pair = nets.schema["edges"].dataType.elementType, nets.schema["pairs"].dataType.elementType
    hop = StructType([StructField("path", IntegerType()), StructField("seq", IntegerType()), edge["edge"], StructField("u", edge["a"].dataType), StructField("v", edge["a"].dataType), StructField("m", DoubleType())])
    schema = StructType([pair["query"], StructField("m", DoubleType()), StructField("paths", LongType()), StructField("routes", ArrayType(hop))])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(sum(pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in batch.columns))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE, "right")))
                yield _solved(batch.slice(at, to - at), target, limit, tolerance, listed)
                at = to

    return nets.select("edges", "pairs").mapInArrow(run, schema)


def _solved(batch: pa.RecordBatch, target: pa.Schema, limit: int, tolerance: float, listed: bool) -> pa.RecordBatch:
    many = batch.num_rows
    of = [np.repeat(np.arange(many), pc.list_value_length(c).to_numpy(zero_copy_only=False)) for c in batch.columns]
    edges, pairs = (c.flatten() for c in batch.columns)
    each = pa.concat_arrays([edges.field("a"), edges.field("b"), pairs.field("source"), pairs.field("target")]).dictionary_encode()
    code = each.indices.to_numpy().astype(np.int64)
    net, names = np.concatenate([of[0], of[0], of[1], of[1]]), max(len(each.dictionary), 1)
    key = net * names + code
    count = len(edges)
    known = np.unique(key[: 2 * count])
    place = np.minimum(np.searchsorted(known, key), len(known) - 1)
    there = known[place] == key
    first = np.searchsorted(known, np.arange(many + 1) * names)
    n = int(np.diff(first).max())
    local = np.where(there, place - first[net], 0)
    row = net * n + local
    # Edges both ways, by the node they lead to.
    x = np.argsort(np.concatenate([row[count : 2 * count], row[:count]]), kind="stable")
    u, v = (np.concatenate([row[i : i + count], row[j : j + count]])[x] for i, j in ((0, count), (count, 0)))
    u_code, v_code = (np.concatenate([code[i : i + count], code[j : j + count]])[x] for i, j in ((0, count), (count, 0)))
    edge, m = x % count, edges.field("m").to_numpy(zero_copy_only=False)[x % count]
    # Distances between all nodes of a net; a row is a node, a column a source of its net.
    far = np.full((many, n, n), np.inf)
    np.minimum.at(far.reshape(-1), u * n + v % n, m)
    far[:, np.arange(n), np.arange(n)] = 0.0
    for k in range(n):
        np.minimum(far, far[:, :, k, None] + far[:, None, k, :], out=far)
    far = far.reshape(many * n, n)
    with np.errstate(invalid="ignore"):
        tight = np.abs(far[u] + m[:, None] - far[v]) <= tolerance
    paths = _counted(tight, u, v, many, n)
    source, goal = row[2 * count : 2 * count + len(pairs)], row[2 * count + len(pairs) :]
    column = source % n
    met = there[2 * count : 2 * count + len(pairs)] & there[2 * count + len(pairs) :]
    length = np.where(met, far[goal, column], np.inf)
    number = np.where(met & np.isfinite(length), paths[goal, column], 0)
    if listed:
        rank = pc.rank(edges.field("edge"), tiebreaker="dense").to_numpy().astype(np.int64)[edge]
        of_pair, path, seq, step = _listed(tight, u, v, rank, source, goal, number, limit)
    else:
        of_pair = path = seq = step = np.zeros(0, np.int64)
    hop = target.field("routes").type.value_type
    cells = [path, seq, edges.field("edge").take(pa.array(edge[step])), each.dictionary.take(pa.array(u_code[step])), each.dictionary.take(pa.array(v_code[step])), m[step]]
    hops = pa.StructArray.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cells, hop, strict=True)], fields=list(hop))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of_pair, minlength=len(pairs)))])
    routes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hops, type=target.field("routes").type)
    reached = np.isfinite(length)
    return pa.RecordBatch.from_arrays([pairs.field("query"), pa.array(np.where(reached, length, 0.0), pa.float64(), mask=~reached), pa.array(number.tolist(), pa.int64()), routes], schema=target)


def _counted(tight: np.ndarray, u: np.ndarray, v: np.ndarray, many: int, n: int, kind: type = np.int64) -> np.ndarray:
    """How many ways of tight edges lead from each source (column) to each node (row)."""
    rows, starts = np.unique(v, return_index=True)
    now = np.zeros((many * n, n), kind)
    now[np.arange(many * n), np.arange(many * n) % n] = 1
    total = now.copy()
    for _ in range(n):
        after = np.zeros((many * n, n), kind)
        after[rows] = np.add.reduceat(np.where(tight, now[u], 0), starts, axis=0)
        if not after.any():
            return total
        if kind is not object and after.max() > 2**48:  # the next sums may not fit
            return _counted(tight, u, v, many, n, object)
        total, now = total + after, after
    raise RuntimeError("shortest_routes: routes not counted")


def _listed(tight, u, v, rank, source, goal, number, limit) -> tuple[np.ndarray, ...]:
    """The steps of each pair's first routes in order: pair, path, seq and the step's directed edge."""
    low, high = np.searchsorted(v, np.arange(v.max() + 2)), np.searchsorted(v, np.arange(v.max() + 2), "right")
    # Few routes: all of them, from the target back. Every tight edge back leads to the source in the end.
    pair = np.flatnonzero((number >= 1) & (number <= limit) & (source != goal))
    node, slot, made = goal[pair], np.full(len(pair), -1), 0
    steps, parents, ends, owners = [], [], [], []
    while len(pair):
        width = high[node] - low[node]
        from_ = np.repeat(np.arange(len(pair)), width)
        e = np.arange(len(from_)) - np.repeat(np.cumsum(width) - width, width) + low[node][from_]
        good = tight[e, (source % tight.shape[1])[pair[from_]]]
        from_, e = from_[good], e[good]
        steps.append(e)
        parents.append(slot[from_])
        pair, node, slot = pair[from_], u[e], made + np.arange(len(e))
        made += len(e)
        done = node == source[pair]
        ends.append(slot[done])
        owners.append(pair[done])
        pair, node, slot = pair[~done], node[~done], slot[~done]
    none = np.zeros(0, np.int64)
    step, parent, at, owner = (np.concatenate([none, *c]).astype(np.int64) for c in (steps, parents, ends, owners))
    route, place, taken, live, seq = [none], [none], [none], np.arange(len(at)), 0
    while len(at):
        seq += 1
        route.append(live)
        place.append(np.full(len(at), seq))
        taken.append(step[at])
        at = parent[at]
        live, at = live[at >= 0], at[at >= 0]
    # Many routes: the first ones, from the source on.
    by_u = np.lexsort((rank, u))
    for p in np.flatnonzero((number > limit) & (source != goal)):
        for found in islice(_from_source(tight[:, source[p] % tight.shape[1]], u, v, by_u, low, high, source[p], goal[p]), limit):
            route.append(np.full(len(found), len(owner)))
            place.append(np.arange(1, len(found) + 1))
            taken.append(np.array(found))
            owner = np.append(owner, p)
    route, place, taken = (np.concatenate(c).astype(np.int64) for c in (route, place, taken))
    ranks = np.full((len(owner), max(int(place.max(initial=0)), 1)), -1)
    ranks[route, place - 1] = rank[taken]
    order = np.lexsort((*ranks.T[::-1], owner))
    path = np.empty(len(owner), np.int64)
    path[order] = np.arange(len(owner)) - np.searchsorted(owner[order], owner[order]) + 1
    final = np.lexsort((place, path[route], owner[route]))
    return owner[route][final], path[route][final], place[final], taken[final]


def _from_source(good, u, v, by_u, low, high, source, goal) -> Iterator[list[int]]:
    """Ways of good edges from source to goal in the order of their edges."""
    leads, going = {goal}, [goal]
    while going:
        at = going.pop()
        for e in range(low[at], high[at]):
            if good[e] and u[e] not in leads:
                leads.add(u[e])
                going.append(u[e])
    starts = u[by_u]
    ahead = lambda at: iter([e for e in by_u[np.searchsorted(starts, at) : np.searchsorted(starts, at, "right")] if good[e] and v[e] in leads])
    way, open_ = [], [ahead(source)]
    while open_:
        e = next(open_[-1], None)
        if e is None:
            open_.pop()
            if way:
                way.pop()
        elif v[e] == goal:
            yield [*way, e]
        else:
            way.append(e)
            open_.append(ahead(v[e]))
