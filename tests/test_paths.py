"""Routes with their edges against plain Dijkstra, on nets with hubs, chains, rings and parallel edges, and on one long line."""

import heapq
import random
from collections import defaultdict

import pytest

from waystone.operators import paths


def frames(spark, edges, pairs):
    return spark.createDataFrame(edges, "edge long, a long, b long, m double"), spark.createDataFrame(pairs, "query long, source long, target long")


def plain_routes(edges, source, target, tolerance=1e-6):
    """All shortest routes as lists of (edge, u, v), sorted by their edges, by Dijkstra and a walk over tight edges."""
    out = defaultdict(list)
    for e, a, b, m in edges:
        if a != b:
            out[a].append((e, b, m))
            out[b].append((e, a, m))

    def distances(start):
        best, heap = {}, [(0.0, start)]
        while heap:
            d, n = heapq.heappop(heap)
            if n not in best:
                best[n] = d
                for _, v, m in out[n]:
                    heapq.heappush(heap, (d + m, v))
        return best

    near, far = distances(source), distances(target)
    if target not in near:
        return None, []
    found = []

    def walk(node, route):
        if node == target:
            found.append(route)
            return
        for e, v, m in sorted(out[node]):
            if v in far and abs(near[node] + m + far[v] - near[target]) <= tolerance and abs(near[v] - near[node] - m) <= tolerance:
                walk(v, [*route, (e, node, v)])

    walk(source, [])
    return near[target], sorted(found, key=lambda r: [x[0] for x in r])


def got_routes(found, routes):
    told = {r["query"]: r for r in found.collect()}
    lists = defaultdict(lambda: defaultdict(list))
    for r in sorted(routes.collect(), key=lambda r: (r["query"], r["path"], r["seq"])):
        lists[r["query"]][r["path"]].append((r["edge"], r["u"], r["v"]))
    return told, lists


@pytest.mark.parametrize("seed", [1, 2])
def test_routes_equal_dijkstra(spark, seed):
    rng, edges = random.Random(seed), []
    node = 100
    for _ in range(30):  # chains between hubs 0 to 9, some of one edge, some loops and parallels
        a, b, n = rng.randrange(10), rng.randrange(10), rng.choice([1, 1, 2, 3, 7])
        at = a
        for k in range(n):
            to = b if k == n - 1 else node
            node += 1
            edges.append((rng.randrange(10**6), at, to, float(rng.choice([1, 2, 3]))))
            at = to
    edges += [(10**7 + k, 9000 + k, 9000 + (k + 1) % 5, 1.0) for k in range(5)]  # a ring apart
    edges = list({e[0]: e for e in edges}.values())
    nodes = sorted({n for e in edges for n in e[1:3]})
    pairs = [(k, rng.choice(nodes), rng.choice(nodes)) for k in range(25)] + [(90, 9000, 9002), (91, 0, 9000), (92, 0, 0), (93, 0, 555555)]
    told, lists = got_routes(*paths.shortest_routes(*frames(spark, edges, pairs), limit=3))
    several = 0
    for q, s, t in pairs:
        m, want = plain_routes(edges, s, t) if t != 555555 else (None, [])
        assert told[q]["paths"] == len(want) and told[q]["exhaustive"] == (len(want) <= 3)
        assert (m is None) == (told[q]["m"] is None) and (m is None or abs(m - told[q]["m"]) < 1e-9)
        assert [lists[q][k] for k in sorted(lists[q])] == [r for r in want[:3] if r]
        several += len(want) > 1
    assert several >= 2


def test_a_long_line_takes_few_rounds(spark, monkeypatch):
    tables = []
    settled = paths.settled
    monkeypatch.setattr(paths, "settled", lambda df: tables.append(1) or settled(df))
    n = 20_000
    edges = [(k, k, k + 1, 1.0) for k in range(n)]
    told, lists = got_routes(*paths.shortest_routes(*frames(spark, edges, [(1, 0, n), (2, n // 2, 5)])))
    assert told[1]["m"] == n and told[1]["paths"] == 1 and len(tables) < 100
    assert [e for e, _, _ in lists[1][1]] == list(range(n)) and [e for e, _, _ in lists[2][1]] == list(range(n // 2 - 1, 4, -1))


def test_corridor_legs_do_not_repeat(spark):
    edges = [(1, 1, 2, 1.0), (2, 2, 3, 1.0), (3, 3, 4, 1.0), (4, 4, 1, 5.0), (5, 7, 8, 1.0), (6, 8, 9, 1.0), (7, 7, 10, 1.0), (8, 10, 9, 1.0)]
    legs = [(1, 1, 1, 3), (1, 2, 3, 2), (1, 3, 3, 4), (2, 1, 7, 9), (2, 2, 1, 9), (3, 1, 2, 3)]
    e, _ = frames(spark, edges, [(0, 0, 0)])
    told, routes = paths.corridor(e, spark.createDataFrame(legs, "corridor long, leg long, source long, target long"))
    got = {(r["corridor"], r["leg"]): (r["status"], r["m"]) for r in told.collect()}
    assert got == {(1, 1): ("accepted", 2.0), (1, 2): ("repeat", 1.0), (1, 3): ("accepted", 1.0), (2, 1): ("ambiguous", 2.0), (2, 2): ("no-path", None), (3, 1): ("accepted", 1.0)}
    assert [r["edge"] for r in sorted(routes.where("corridor = 1 and leg = 1").collect(), key=lambda r: r["seq"])] == [1, 2]


def test_small_nets_give_what_rounds_give(spark):
    rng, edges, pairs = random.Random(3), [], []
    for net in range(12):  # few lengths, so that many routes are alike; some edges are parallel, one net holds fifty nodes
        nodes = [net * 100 + k for k in range(50 if net == 0 else 8)]
        edges += [(len(edges) + k, rng.choice(nodes), rng.choice(nodes), float(rng.choice([1, 1, 2]))) for k in range(3 * len(nodes))]
        pairs += [(len(pairs) + k, rng.choice(nodes), rng.choice(nodes)) for k in range(12)]
    pairs += [(900, 3, 103), (901, 5555, 5555), (902, 5555, 3), (903, 3, 5555)]
    e, p = frames(spark, edges, pairs)
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    inside, beyond = paths.shortest_routes(e, p, limit=3), paths.shortest_routes(e, p, limit=3, whole=0)
    assert rows(inside[0]) == rows(beyond[0]) and rows(inside[1]) == rows(beyond[1])
    assert inside[0].where("not exhaustive").count() >= 3 and inside[0].where("m is null").count() >= 3


@pytest.mark.parametrize("legs_of_places", [True, False])
def test_a_small_net_takes_no_round_a_hop(spark, monkeypatch, legs_of_places):
    """A ladder of thirty rungs: F7 and F8 wrote a table or more for each hop of the longest route."""
    tables = []
    settled = paths.settled
    monkeypatch.setattr(paths, "settled", lambda df: tables.append(1) or settled(df))
    n = 30
    edges = [(k, k, k + 1, 1.0) for k in range(n - 1)] + [(100 + k, 100 + k, 101 + k, 1.0) for k in range(n - 1)] + [(200 + k, k, 100 + k, 1.0) for k in range(n)]
    e = spark.createDataFrame(edges, "edge long, a long, b long, m double")
    if legs_of_places:
        nodes = spark.createDataFrame([(k + up, float(k), up / 100.0) for k in range(n) for up in (0, 100)] + [(7000, 3.0, 0.0)], "id long, x double, y double")
        legs = spark.createDataFrame([(q, 0.0, 0.0, n - 1.0, 0.0) for q in range(3)] + [(3, 3.0, 0.0, 5.0, 0.0), (4, 0.5, 0.0, 5.0, 0.0)], "query long, sx double, sy double, tx double, ty double")
        got = {r["query"]: (r["source"], r["m"], r["paths"], r["status"]) for r in paths.corridor_legs(e, nodes, legs, 1.8, 1e-6).collect()}
        assert got == {q: (0, n - 1.0, 1, "accepted") for q in range(3)} | {3: (3, 2.0, 1, "accepted"), 4: (None, None, 0, "no-anchor")}
    else:
        legs = spark.createDataFrame([(1, 1, 0, n - 1), (1, 2, 5, 4)], "corridor long, leg long, source long, target long")
        assert {(r["leg"], r["m"], r["status"]) for r in paths.corridor(e, legs)[0].collect()} == {(1, n - 1.0, "accepted"), (2, 1.0, "repeat")}
    assert len(tables) < 10
