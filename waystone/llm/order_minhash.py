"""Near-duplicates by order MinHash over five-word shingles, verified by banded alignment."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waystone.llm import pieces
from waystone.llm.shared import classes, key_filter, maybe_in, partitions, spent, union_all, written

#: Words of a shingle and the similarity of near-duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Sketches of a text, and the minimum shingles that each keeps in text order.
SKETCHES, MINIMA = 16, 4
#: Texts of at most FEW shingles keep FEWER minima instead, as one shingle is a large share of theirs; texts that can be near
#: both to such a text and to a longer one have sketches of both kinds.
FEW, FEWER = 32, 2
#: Plain minima kept as bytes, and how many of them near-duplicates share (five deviations below what 0.8 gives).
BYTES, LEAST_BYTES = 128, 80
#: Nodes of a bucket that are screened, and texts that are compared, in one place; what is larger is compared in blocks, never cut.
BUCKET, GROUP = 2048, 256
PIVOTS = 16
#: Characters for which a text counts once among the GROUP: a longer one counts more, so that a place holds a bounded amount.
UNIT = 1 << 16

_RNG = np.random.default_rng(11)
_SKETCH_FACTORS = _RNG.integers(0, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_FACTORS = _RNG.integers(0, 2**63, BYTES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(31)


def words_of(texts: list[str]) -> list[np.ndarray]:
    """The words (lower case, split at white space) of each text as 64-bit hashes."""
    cut = pieces.Cut([t.lower() for t in texts], "white")
    return np.split(_mixed(cut.hash), np.searchsorted(cut.owner, np.arange(1, len(texts)))) if texts else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles in text order, each labelled with how often it has come before; one for a shorter text."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _STEP + words[k : k + len(h)]
    h = _mixed(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    again = np.flatnonzero(s[1:] == s[:-1]) + 1
    if len(again):
        start = np.arange(len(s))
        start[again] = 0
        start = np.maximum.accumulate(start)
        seen = np.empty(len(s), np.uint64)
        seen[order] = (np.arange(len(s)) - start).astype(np.uint64)
        h = np.where(seen > 0, _mixed(h + seen * _STEP), h)
    return h


def _keys(h: np.ndarray, place: np.ndarray, first: int) -> np.ndarray:
    """One key per row of places: its shingles in text order. first: tells kinds of sketches apart."""
    key = np.arange(first, first + SKETCHES, dtype=np.uint64) * _STEP
    for column in h[np.sort(place, axis=1)].T:
        key = _mixed(key * _STEP + column)
    return key


def sketch(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The keys of the order-MinHash sketches (of FEWER minima, of MINIMA or of both), and the low byte of the plain minima, of
    labelled shingles."""
    k = min(MINIMA, len(h))
    best_value, best_place = np.zeros((SKETCHES, 0), np.uint64), np.zeros((SKETCHES, 0), np.int64)
    low = np.full(BYTES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 1 << 13):  # bounded memory for a text of any length
        part = h[a : a + (1 << 13)]
        value = _mixed(part[None, :] * _SKETCH_FACTORS[:, None])
        place = np.argpartition(value, min(k, len(part)) - 1, axis=1)[:, :k]
        best_value = np.concatenate((best_value, np.take_along_axis(value, place, 1)), 1)
        best_place = np.concatenate((best_place, place + a), 1)
        if best_value.shape[1] > k:
            keep = np.argpartition(best_value, k - 1, axis=1)[:, :k]
            best_value, best_place = np.take_along_axis(best_value, keep, 1), np.take_along_axis(best_place, keep, 1)
        np.minimum(low, (part[None, :] * _BYTE_FACTORS[:, None]).min(axis=1), out=low)
    keys = []
    if len(h) >= SIMILAR * FEW:
        keys.append(_keys(h, best_place, 1))
    if len(h) <= FEW:
        least = np.argsort(best_value, axis=1)[:, :FEWER]
        keys.append(_keys(h, np.take_along_axis(best_place, least, 1), 1 + SKETCHES))
    return np.concatenate(keys).view(np.int64), (_mixed(low) >> np.uint64(56)).astype(np.uint8).tobytes()


def aligned_runs(a: list[int], b: list[int], band: int) -> list[int] | None:
    """Lengths of the runs of equal words in an alignment with the fewest words left over (deleted or inserted); None if
    that takes more than `band` of them. Diagonals farther out than the band are never visited."""
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    reach = {1: 0}
    trail: list[dict[int, int]] = []
    for d in range(band + 1):
        trail.append(dict(reach) if d else {1: 0})
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            reach[k] = x
            if x >= n and y >= m:
                runs, x, y = [], n, m
                for e in range(d, -1, -1):
                    v, k = trail[e], x - y
                    down = k == -e or (k != e and v.get(k - 1, -1) < v.get(k + 1, -1))
                    start = v[k + 1] if down else v.get(k - 1, 0) + 1
                    if e == 0:
                        start = 0
                    runs.append(x - start)
                    x, y = (start, start - k - 1) if down else (start - 1, start - k)
                return runs[::-1]
    return None


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> list[int]:
    """aligned_runs of two arrays, whose common start and end are taken off before; empty beyond the band."""
    short = min(len(a), len(b))
    other = np.flatnonzero(a[:short] != b[:short])
    head = int(other[0]) if len(other) else short
    rest = short - head
    other = np.flatnonzero(a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1])
    tail = int(other[0]) if len(other) else rest
    runs = aligned_runs(a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist(), band)
    if runs is None:
        return []
    runs[0] += head
    runs[-1] += tail
    return runs


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles in aligned order over all shingles of two texts' words; 0 where the band shows it is below SIMILAR.

    Words are aligned first, as that takes the fewest steps; chance matches between two edits can break a shingle there, so
    a pair that falls short has its shingles themselves aligned."""
    if len(a) < SHINGLE or len(b) < SHINGLE:
        return float(len(a) > 0 and np.array_equal(a, b))
    na, nb = len(a) - SHINGLE + 1, len(b) - SHINGLE + 1
    band = (na + nb) // 9 + 2 * SHINGLE  # two texts of similarity 0.8 leave at most a ninth of their shingles over
    shared = sum(max(0, r - SHINGLE + 1) for r in aligned(a, b, band))
    if shared < SIMILAR * (na + nb - shared):
        shared = sum(aligned(shingles(a), shingles(b), (na + nb) // 9 + 1))
    return shared / (na + nb - shared)


def group_links(names: list[bytes], words: list[np.ndarray], first: int | None = None) -> list[tuple[bytes, bytes]]:
    """Links that join the near-duplicates of a group (the words of their texts) into classes: every pair is compared, unless it
    is joined already.

    first: only pairs of one of the first rows with another one. Before its alignment a pair must share LEAST_BYTES bytes,
    and its multiset Jaccard, which bounds the aligned similarity, must reach SIMILAR."""
    sets = [np.sort(shingles(w)) for w in words]
    low = np.frombuffer(b"".join(sketch(h)[1] if len(h) else bytes(BYTES) for h in sets), np.uint8).reshape(len(sets), BYTES)
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(names) if first is None else first):
        for j in (np.flatnonzero((low[i + 1 :] == low[i]).sum(axis=1) >= LEAST_BYTES) + i + 1).tolist():
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small < SIMILAR * large or not small or find(i) == find(j):
                continue
            both = np.concatenate((sets[i], sets[j]))
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            if shared >= SIMILAR * (small + large - shared) - 1e-9 and similarity(words[i], words[j]) >= SIMILAR - 1e-9:
                out.append((names[i], names[j]))
                root[find(j)] = find(i)
    return out


def node(text: Column) -> Column:
    """The name of a text: texts that are equal are one node (null: empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sketched(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, node, weight (in UNITs of text), keys (empty for a text without words) and low, the bytes of the
    plain minima."""

    def run(batches):
        pieces.forget()
        for batch in batches:
            names, keys, low, weights = [], [], [], []
            for _, _, texts in pieces.text_blocks(batch.column("text")):
                names += [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
                weights += [len(t) // UNIT + 1 for t in texts]
                for w in words_of(texts):
                    k, s = sketch(shingles(w)) if len(w) else ([], b"")
                    keys.append(k)
                    low.append(s)
            weight = pa.array(weights, pa.int64())
            columns = [batch.column("doc_id"), pa.array(names, pa.binary()), weight, pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "weight", "keys", "low"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node binary, weight long, keys array<long>, low binary")


def _crowded(rows: DataFrame, name: str) -> DataFrame:
    """rows (key, node) with n, the size of the bucket, where it is above 1."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return written(rows.join(counts, "key"), name)


def _screened(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Buckets, or blocks of them, of about BUCKET nodes at most: links (a, b) that join the members which could be near-duplicates by their bytes."""
    members = hits.join(nodes.select("node", "low"), "node").groupBy("key").agg(F.collect_list(F.struct("node", "low")).alias("m")).select("m")

    def run(batches):
        pieces.forget()
        for batch in batches:
            a, b = [], []
            for bucket in batch.column("m"):  # one bucket at a time: a batch may hold very many
                m = sorted(bucket.as_py(), key=lambda x: x["node"])
                names = [x["node"] for x in m]
                x = np.frombuffer(b"".join(x["low"] for x in m), np.uint8).reshape(len(m), BYTES)
                near = np.concatenate([(x[k : k + 32, None, :] == x[None, :, :]).sum(axis=2) >= LEAST_BYTES for k in range(0, len(m), 32)])
                left = np.ones(len(m), bool)
                while left.any():
                    first = int(left.argmax())
                    front = np.array([first])
                    left[first] = False
                    while len(front):
                        front = np.flatnonzero(near[front].any(axis=0) & left)
                        left[front] = False
                        a += [names[first]] * len(front)
                        b += [names[i] for i in front.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return members.mapInArrow(run, "a binary, b binary").distinct()


def _gid(*columns: str) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", *[F.hex(x) for x in columns]).cast("binary")))


def _dealt(n: str, size: int) -> Column:
    return F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / size).cast("long"))


def _every_block(n: str, size: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / size).cast("long") - 1))


def _blocks(rest: DataFrame, key: str, most: int) -> DataFrame:
    """Sets (key, node, n: their weight) dealt to blocks of a weight of about `most` that share pivots: gid, node."""
    size = max(most - PIVOTS, 1)
    blocks = rest.select(key, "node", _dealt("n", size).alias("block"))
    places = F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("p")
    pivots = rest.groupBy(key, places).agg(F.min("node").alias("node"), F.max("n").alias("n")).select(key, "node", _every_block("n", size).alias("block"))
    return blocks.unionByName(pivots).distinct().select(_gid(key, "block").alias("gid"), "node")


def _crossed(state: DataFrame, key: str, most: int) -> DataFrame | None:
    """After _blocks: what is outside its set's main class (state: key, node, weight, class_id) with every node of the set, as
    groups (gid, node, side) of a weight of about `most`; side 0: outside. None if nothing is outside."""
    sizes = state.groupBy(key, "class_id").agg(F.sum("weight").alias("c"))
    main = sizes.groupBy(key).agg(F.max_by("class_id", F.struct("c", "class_id")).alias("main"), F.sum("c").alias("n"), F.max("c").alias("most"))
    main = main.withColumn("odd", F.col("n") - F.col("most")).where("odd > 0")
    left = state.join(main, key).where("class_id <> main")
    if left.isEmpty():
        return None
    half = most // 2
    odd = left.select(key, "node", _dealt("odd", half).alias("i"), _every_block("n", half).alias("j"), F.lit(0).alias("side"))
    every = state.join(main, key).select(key, "node", _every_block("odd", half).alias("i"), _dealt("n", half).alias("j"), F.lit(1).alias("side"))
    return odd.unionByName(every).groupBy(key, "i", "j", "node").agg(F.min("side").alias("side")).select(_gid(key, "i", "j").alias("gid"), "node", "side")


def _labelled(sets: DataFrame, links: DataFrame, key: str, name: str) -> DataFrame:
    """sets (key, node, weight) with the class_id that the links give each node."""
    labels = classes(links).withColumnRenamed("id", "node")
    return written(sets.join(labels, "node", "left").select(key, "node", "weight", F.coalesce("class_id", "node").alias("class_id")), name)


def _wanted(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the nodes (node, rep) alone, as a table that every comparison reads.

    A filter of the wanted (rep, node) passes the rows to bring together before any text moves: other rows' texts, those of
    further copies too, are exchanged only where the filter errs."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", node(F.col("text")))
    near = maybe_in(keyed, [F.col("doc_id"), F.col("node")], key_filter(nodes.select("rep", "node")), "maybe").where("maybe")
    once = near.groupBy("node").agg(F.first("text").alias("text"))
    return written(once.join(nodes.select("node").hint("merge"), "node", "left_semi"), "texts")


def _compared(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) within groups (gid, node, side; side 0: compared with all others of the group, 1: only with side 0).

    texts: node, text. A group, at most 2 GROUP texts and 2 GROUP UNITs of text or about, is compared in one place."""
    met = texts.join(groups.hint("merge"), "node").select("gid", "node", "side", "text")  # both grow with the corpus: never broadcast
    dealt = met.repartition(partitions(texts.sparkSession), "gid").sortWithinPartitions("gid", "side", "node")

    def run(batches):
        pieces.forget()
        held, rows = None, {}

        def done():
            names = list(rows)
            side = [rows[x][0] for x in names]
            found = group_links(names, [rows[x][1] for x in names], side.count(0)) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            gids, names, sides = (batch.column(c).to_pylist() for c in ("gid", "node", "side"))
            for a, b, texts in pieces.text_blocks(batch.column("text")):  # a group's texts are held as their words' hashes
                for gid, name, side, words in zip(gids[a:b], names[a:b], sides[a:b], words_of(texts), strict=True):
                    if gid != held:
                        if rows:
                            yield done()
                        held, rows = gid, {}
                    rows.setdefault(name, (side, words.copy()))
        if rows:
            yield done()

    return dealt.mapInArrow(run, "a binary, b binary")


def near_classes(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id and class_id, the least doc_id of its class of exact and near copies."""
    named = _named(docs).select("doc_id", "label")
    return named.join(named.groupBy("label").agg(F.min("doc_id").alias("class_id")), "label").select("doc_id", "class_id")


def _named(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, node and label, which rows of one class of exact and near copies share.

    Equal texts (null: empty) are one node. Nodes that agree in one of SKETCHES order-MinHash sketches meet in a bucket: a
    sketch is the MINIMA least occurrence-labelled shingles in text order, so that a pair of similarity 0.8 agrees in one
    with probability above 0.999 (texts of few shingles keep fewer minima for that). Buckets of more than BUCKET nodes are
    screened in blocks that share pivots, and what is outside a bucket's main class with every other member. Members that share
    enough bytes of plain minima form clusters (over all buckets), and a cluster's texts are brought together once: in one
    group of at most GROUP, or else in blocks that share pivots, after which every node outside the cluster's main class
    meets every other. Links are verified by banded alignment; classes are their connected components. Within a cluster no
    link between two texts is lost, and no pair is written out unless it is a link that joins two classes. Texts without
    words only match equal ones; an empty table gives no rows; equal doc_ids with different texts are told apart; very long
    texts weigh more, so fewer share a group; other columns are not read.
    """
    table = written(sketched(docs), "sketches")
    first = [F.first(c).alias(c) for c in ("weight", "keys", "low")]
    nodes = written(table.groupBy("node").agg(F.min("doc_id").alias("rep"), *first), "nodes")
    hits = _crowded(nodes.select(F.explode("keys").alias("key"), "node", F.lit(1).cast("long").alias("weight")), "hits")
    linked = [written(_screened(hits.where(F.col("n") <= BUCKET), nodes), "screened")]
    large = hits.where(F.col("n") > BUCKET)
    if not large.isEmpty():
        linked.append(written(_screened(_blocks(large, "key", BUCKET).withColumnRenamed("gid", "key"), nodes), "screened"))
        crossed = _crossed(_labelled(large, union_all(linked), "key", "met"), "key", BUCKET)
        if crossed is not None:
            linked.append(_screened(crossed.withColumnRenamed("gid", "key"), nodes))
    clusters = classes(union_all(linked)).select(F.col("id").alias("node"), F.col("class_id").alias("cluster"))
    clusters = clusters.join(nodes.select("node", "rep", "weight"), "node")
    placed = written(clusters.join(clusters.groupBy("cluster").agg(F.sum("weight").alias("n")), "cluster"), "clusters")
    texts = _wanted(docs, placed.select("node", "rep"))
    groups = placed.where(F.col("n") <= GROUP).select(F.col("cluster").alias("gid"), "node", F.lit(0).alias("side"))
    rest = placed.where(F.col("n") > GROUP)
    wide = not rest.isEmpty()
    if wide:
        groups = groups.unionByName(_blocks(rest, "cluster", GROUP).select("gid", "node", F.lit(0).alias("side")))
    links = written(_compared(groups, texts), "links")
    labels = classes(links)
    if wide:
        state = rest.join(labels.withColumnRenamed("id", "node"), "node", "left")
        state = written(state.select("cluster", "node", "weight", F.coalesce("class_id", "node").alias("class_id")), "placed")
        crossed = _crossed(state, "cluster", GROUP)
        if crossed is not None:
            labels = classes(links.unionByName(written(_compared(crossed, texts), "links")))
    spent(hits, placed, texts, links)
    return table.select("doc_id", "node").join(labels.withColumnRenamed("id", "node"), "node", "left").select("doc_id", "node", F.coalesce("class_id", "node").alias("label"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the one with the least doc_id (null last; of its rows with that id the one with the
    least node). Rows of other classes that share the id don't matter.

    Which rows go is known by (doc_id, node). A filter of those tells most rows that stay where they lie; only the rows that
    it may mean are exchanged and told apart exactly."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = written(_named(docs).groupBy("label", "doc_id", "node").agg(F.count("*").alias("n")), "named")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    best = named.groupBy("label").agg(F.min(order).alias("best"))
    whole = named.join(best, "label").withColumn("keep", order == F.col("best"))
    odd = written(whole.where("not keep or n > 1").select("doc_id", "node", "keep"), "odd")
    if odd.isEmpty():
        return docs
    rows = docs.select(F.struct(*columns).alias("doc"), F.col("doc_id"), node(F.col("text")).alias("node"))
    rows = maybe_in(rows, [F.col("doc_id"), F.col("node")], key_filter(odd.select("doc_id", "node")), "maybe")
    near = rows.where("maybe").alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.node") == F.col("o.node"))
    met = near.join(odd.hint("merge").alias("o"), same, "left").select("r.doc", "r.doc_id", "r.node", "o.keep")
    again = met.where("keep").groupBy("doc_id", "node").agg(F.first("doc").alias("doc"))  # a kept row that is there more than once
    out = union_all([rows.where("not maybe").select("doc"), met.where("keep is null").select("doc"), again.select("doc")])
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
