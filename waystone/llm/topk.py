"""Exact top-k by inner product: segment statistics bound every pair from coarse to fine, survivors are computed exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waystone.llm.shared import written

SCALE, K = 64.0, 20
#: Segments of a vector, coarse to fine.
LEVELS = (4, 8, 16)
#: Rows of a block of candidates and of queries, about; queries bounded at a time.
CANDIDATES, QUERIES, CHUNK = 8192, 2048, 128
#: Shells of candidates by norm.
SHELLS = 16
#: Shares of pairs above which a block product is cheaper than single pairs, and above which finer bounds don't pay.
DENSE, HOPELESS = 0.02, 0.5


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row and segment sqrt(length) * mean, then the norm of what deviates from the mean.

    With these, |q - c|^2 >= sum over segments of (difference of means)^2 * length + (difference of deviations)^2, and so
    q.c <= the product of the two rows of statistics."""
    bounds = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        out += [mean * np.sqrt(b - a), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1)


def search_block(q, q_row, c, c_row, c_id, k: int = K, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k candidates of each query in a block: query index, candidate index and exact score.

    q, c: integer matrices; q_row, c_row: the rows' own numbers (a row is no candidate of itself). Ties: smaller id. floor:
    per query a score that k candidates elsewhere reach, so that less can't be among its best."""
    if not len(q) or not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    exact = most < 2**52
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    sides = [(statistics(qf, s), statistics(cf, s)) for s in LEVELS] if q.shape[1] else []
    slack = 1e-6 + 1e-9 * (np.linalg.norm(qf, axis=1) * np.linalg.norm(cf, axis=1).max(initial=0.0))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    floor = np.full(len(q), -np.inf) if floor is None else floor.astype(np.float64)

    def scores(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        if exact:
            return np.rint(np.concatenate([np.einsum("ij,ij->i", qf[rows[i : i + 65536]], cf[cols[i : i + 65536]]) for i in range(0, len(rows), 65536)] or [np.zeros(0)])).astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", q[rows[i : i + 65536]], c[cols[i : i + 65536]]) for i in range(0, len(rows), 65536)] or [np.zeros(0, np.int64)])

    for a in range(0, len(q), CHUNK):
        b = min(len(q), a + CHUNK)
        live = q_row[a:b, None] != c_row[None, :]
        need = floor[a:b]
        for level, (sq, sc) in enumerate(sides):
            if live.mean() > DENSE:
                bound = sq[a:b] @ sc.T
                bound[~live] = -np.inf
            else:  # few pairs are left: only they are bounded
                rows, cols = np.nonzero(live)
                bound = np.full(live.shape, -np.inf)
                for i in range(0, len(rows), 262144):
                    r, s = rows[i : i + 262144], cols[i : i + 262144]
                    bound[r, s] = np.einsum("ij,ij->i", sq[a + r], sc[s])
            if level == 0 and len(c) > 2 * k:  # the likeliest candidates give the score that others must reach
                seeds = np.argpartition(bound, len(c) - 2 * k, axis=1)[:, -2 * k :]
                rows = np.repeat(np.arange(b - a), seeds.shape[1])
                got = np.where(live[rows, seeds.ravel()], scores(a + rows, seeds.ravel()).astype(np.float64), -np.inf).reshape(seeds.shape)
                need = np.maximum(need, np.partition(got, got.shape[1] - k, axis=1)[:, -k])
            live &= bound >= (need - slack[a:b])[:, None]
            if live.mean() > HOPELESS:  # finer bounds would cost what the scores of the survivors do
                break
        if exact and live.mean() > DENSE and len(c) > k:  # one block product gives all survivors' scores
            product = qf[a:b] @ cf.T
            product[~live] = -np.inf
            live &= product >= np.maximum(np.partition(product, len(c) - k, axis=1)[:, len(c) - k], need)[:, None]
            rows, cols = np.nonzero(live)
            score = np.rint(product[rows, cols]).astype(np.int64)
        else:
            rows, cols = np.nonzero(live)
            score = scores(a + rows, cols)
            high = score >= need[rows]
            rows, cols, score = rows[high], cols[high], score[high]
        order = np.lexsort((c_row[cols], c_id[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        first = np.searchsorted(rows, np.arange(b - a))
        keep = np.arange(len(rows)) - first[rows] < k
        found.append((a + rows[keep], cols[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """row, vec_id, dim, v (the components as floor(64 x)) and norm; vectors null or with null or non-finite components are
    left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite
    kept = vectors.select("vec_id", "embedding").where(F.coalesce(whole, F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("long"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    ids = F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim")
    return kept.select(*ids, v.alias("v")).withColumn("norm", norm)


def _packed(df: DataFrame, name: str) -> DataFrame:
    """One row per (dim, shell, block): the rows' numbers, ids, components and floors as bytes."""
    kinds = {"row": pa.binary(), "id": pa.binary(), "v": pa.binary(), "small": pa.bool_(), "floor": pa.binary()}
    schema = pa.schema([("dim", pa.int32()), ("shell", pa.int32()), ("block", pa.int64()), *[(f"{name}_{c}", kind) for c, kind in kinds.items()]])

    def pack(key, group):
        v = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
        small = bool(np.abs(v).max(initial=0) < 2**15)
        raw = {c: group.column(c).to_numpy().astype(kind).tobytes() for c, kind in (("row", "<i8"), ("vec_id", "<i8"), ("floor", "<f8"))}
        row = [*(x.as_py() for x in key), raw["row"], raw["vec_id"], (v.astype("<i2") if small else v).tobytes(), small, raw["floor"]]
        return pa.table([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    spark_kinds = {"small": "boolean"}
    return df.groupBy("dim", "shell", "block").applyInArrow(pack, f"dim int, shell int, block long, {', '.join(f'{name}_{c} {spark_kinds.get(c, "binary")}' for c in kinds)}")


def _searched(q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """The best of packed query blocks (dim, qb, shell, cb) among the candidate blocks with which they agree in these."""

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                ids = {f"{s}_{y}": np.frombuffer(x[f"{s}_{y}"], "<i8") for s in "qc" for y in ("row", "id")}
                q_v, c_v = (np.frombuffer(x[f"{s}_v"], "<i2" if x[f"{s}_small"] else "<i8").reshape(len(ids[f"{s}_id"]), x["dim"]).astype(np.int64) for s in "qc")
                a, b, score = search_block(q_v, ids["q_row"], c_v, ids["c_row"], ids["c_id"], k, np.frombuffer(x["q_floor"], "<f8"))
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in (ids["q_row"][a], ids["q_id"][a], ids["c_row"][b], ids["c_id"][b], score)], ["query_row", "query_id", "row", "vec_id", "score"])

    met = q.join(c, ["dim", "qb", "shell", "cb"]).select("dim", "q_floor", *[f"{s}_{x}" for s in "qc" for x in ("row", "id", "v", "small")])
    return met.mapInArrow(search, "query_row long, query_id long, row long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """Per query row (vec_id divisible by `every`) its k best other rows: query_id, rank, vec_id, score.

    First every query meets one hashed block of about CANDIDATES rows, whose k-th best score is the query's floor. The other
    candidates lie in shells of like norm, dealt by hash to blocks of bounded size; a block of queries is sent only to shells
    that can reach its least floor (no score is above the product of the norms), and what a block pair returns has reached
    the floor. Ties go to the smaller vec_id; repeated rows are candidates of each other; fewer candidates than k give fewer
    rows; no queries, none. Components beyond 2^28 in size are out of the exact range.
    """
    rows = written(integer_vectors(vectors), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0)
    n, top = rows.agg(F.count("*"), F.max("norm")).head()
    parts = max(1, -(-queries.count() // QUERIES))
    deal = lambda count: F.pmod(F.xxhash64("row"), F.lit(count).cast("long"))
    first = deal(max(1, -(-n // CANDIDATES))) == 0
    spread = lambda last, name: F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias(name)
    none = F.lit(-math.inf).alias("floor")

    def packed_queries(df: DataFrame, floor) -> DataFrame:
        return _packed(df.select("*", F.lit(0).alias("shell"), deal(parts).alias("block"), floor), "q").withColumnRenamed("block", "qb").drop("shell")

    def packed_candidates(df: DataFrame, shell, block) -> DataFrame:
        out = _packed(df.select("*", shell.alias("shell"), block.alias("block"), none), "c").withColumnRenamed("block", "cb")
        return out.select("*", spread(F.lit(parts - 1), "qb"))

    sample = packed_candidates(rows.where(first), F.lit(0), F.lit(0).cast("long"))
    seen = written(_searched(packed_queries(queries, none).select("*", F.lit(0).alias("shell"), F.lit(0).cast("long").alias("cb")), sample, k), "sample")
    floors = seen.groupBy(F.col("query_row").alias("row")).agg(F.min("score").cast("double").alias("_low"), F.count("*").alias("_n")).where(F.col("_n") >= k).select("row", "_low")
    known = queries.join(floors, "row", "left").withColumn("_low", F.coalesce("_low", F.lit(-math.inf)))
    shell = F.least(F.floor(F.col("norm") / F.lit(float(top or 1.0) or 1.0) * SHELLS), F.lit(SHELLS - 1)).cast("int")
    rest = rows.where(~first).withColumn("shell", shell)
    sizes = rest.groupBy("shell").agg(F.count("*").alias("_n"), F.max("norm").alias("_norm"))  # at most SHELLS rows
    sizes = F.broadcast(sizes.select("shell", F.ceil(F.col("_n") / CANDIDATES).alias("_blocks"), "_norm"))
    c = packed_candidates(rest.join(sizes, "shell").select("row", "vec_id", "dim", "v", "norm", "_blocks", F.col("shell").alias("_shell")), F.col("_shell"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("_blocks")))
    least = known.groupBy("dim", deal(parts).alias("qb")).agg(F.min(F.coalesce(F.try_divide("_low", "norm"), F.lit(-math.inf))).alias("_least"))
    q = packed_queries(known, F.col("_low").alias("floor")).join(least, ["dim", "qb"])
    q = q.join(sizes, F.col("_norm") * (1 + 1e-9) >= F.col("_least")).select("dim", "qb", "shell", spread(F.col("_blocks") - 1, "cb"), *[f"q_{x}" for x in ("row", "id", "v", "small", "floor")])  # a row per shell that can matter
    found = seen.unionByName(_searched(q, c, k))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
