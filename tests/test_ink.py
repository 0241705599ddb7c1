"""The phases of a plate's ink against a plain loop."""

import random
from collections import Counter

from waystone.operators import select

RESERVES, ROADS, CONTEXT = {"major": 60.0, "water": 40.0, "paths": 30.0}, ["major", "local"], ["water", "paths", "green"]


def plain(groups, capacity):
    """groups of one plate: layer, key, ink, rank, tile."""
    def ordered(mine):
        out = []
        for rank in sorted({g[3] for g in mine}):
            tiles = {}
            for g in sorted((g for g in mine if g[3] == rank), key=lambda g: g[1]):
                tiles.setdefault(g[4], []).append(g)
            for n in range(max(map(len, tiles.values()))):
                out += [tiles[t][n] for t in sorted(tiles) if n < len(tiles[t])]
        return out

    lanes = {name: ordered([g for g in groups if g[0] == name]) for name in [*RESERVES, *ROADS, *CONTEXT]}
    late = ordered([g for g in groups if g[0] not in lanes])
    kept, names = {}, list(RESERVES)
    spent = lambda: sum(g[2] for g, _ in kept.values())
    buy = lambda g, phase: kept.__setitem__(g[1], (g, phase))
    fit = {n: [g for g in lanes[n] if g[2] <= capacity] for n in names}
    asked = {n: min(sum(g[2] for g in lanes[n]), RESERVES[n]) for n in names}
    claim = {n: min(asked[n], sum(g[2] for g in fit[n])) for n in names}
    of = lambda n: sum(g[2] for g, _ in kept.values() if g[0] == n)
    for i, n in enumerate(names):
        room = max(0.0, capacity - spent() - sum(min(g[2] for g in fit[m]) for m in names[i + 1 :] if fit[m]))
        seed = next((g for g in lanes[n] if g[2] <= room), None)
        if seed:
            buy(seed, "seed")
    for i, n in enumerate(names):
        room = max(0.0, capacity - spent() - sum(max(0.0, claim[m] - of(m)) for m in names[i + 1 :]))
        for g in lanes[n]:
            if of(n) >= asked[n]:
                break
            if g[1] not in kept and g[2] <= room:
                buy(g, "grow")
                room -= g[2]
    for n in ROADS:
        for g in lanes[n]:
            if g[1] not in kept and g[2] <= capacity - spent():
                buy(g, "road")
    queues = {n: [g for g in lanes[n] if g[1] not in kept] for n in CONTEXT}
    while any(queues.values()):
        n = min((n for n in CONTEXT if queues[n]), key=lambda n: (of(n), CONTEXT.index(n)))
        g = queues[n].pop(0)
        if g[2] <= capacity - spent():
            buy(g, "context")
    for g in late:
        if g[2] <= capacity - spent():
            buy(g, "late")
    return {(k, phase) for k, (_, phase) in kept.items()}


def test_ink_phases(spark):
    rng, rows = random.Random(8), []
    for plate in range(12):
        for i in range(rng.choice([0, 5, 60, 120])):
            layer = rng.choice(["major", "local", "water", "paths", "green", "odd", None])
            size = float(rng.choice([rng.randint(1, 9), rng.randint(10, 60), 500]))
            if plate % 3 == 0 and layer == "water":
                size = 70.0  # a layer whose groups are larger than its reserve
            rows.append((plate, layer, f"g{i:03d}", size, rng.randrange(3), rng.randrange(4)))
    rows.append((0, "major", "none", None, 0, 0))
    df = spark.createDataFrame(rows, "plate int, layer string, key string, ink double, rank int, tile int")
    seen = Counter()
    for capacity in (150.0, 400.0):
        got = select.ink_phases(df, "plate", "layer", "key", "ink", "rank", "tile", capacity, RESERVES, ROADS, CONTEXT).collect()
        for plate in range(12):
            mine = {(r["key"], r["phase"]) for r in got if r["plate"] == plate}
            assert mine == plain([r[1:] for r in rows if r[0] == plate and r[3] is not None], capacity)
            assert sum(r["ink"] for r in got if r["plate"] == plate) <= capacity + 1e-6
        seen.update(r["phase"] for r in got)
    assert set(seen) == {"seed", "grow", "road", "context", "late"}
