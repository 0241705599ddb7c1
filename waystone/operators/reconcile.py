"""Tables held against each other: references, manifests, stages, patches, releases and contracts. Every function takes and gives
DataFrames; keys are equi-joined, contents by their digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def member_resolution(members: DataFrame, ways: DataFrame, support: Column) -> DataFrame:
    """Members (relation_id, way_id, ..) by what became of them: missing (no such way), support or resolved, with n."""
    there = ways.select("way_id", F.lit(True).alias("_there")).distinct()
    state = F.when(F.col("_there").isNull(), "missing").when(support, "support").otherwise("resolved")
    return members.join(there, "way_id", "left").groupBy("relation_id", state.alias("resolution")).agg(F.count("*").alias("n"))


def missing_references(refs: DataFrame, ref: str, known: DataFrame, key: str) -> DataFrame:
    """Rows of refs whose non-null ref is no key of known."""
    return refs.where(F.col(ref).isNotNull()).join(known.select(F.col(key).alias("_known")), F.col(ref) == F.col("_known"), "left_anti")


def broken_references(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, broken: how many rows each named check (a table of bad rows) has found."""
    out = None
    for name, rows in rules.items():
        one = rows.agg(F.lit(name).alias("rule"), F.count("*").alias("broken"))
        out = one if out is None else out.unionByName(one)
    return out


def reference_closure(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References (ref) that lead to nothing known (ref), with their uses."""
    return refs.groupBy("ref").agg(F.count("*").alias("uses")).join(known.select("ref"), "ref", "left_anti")


def active_stop_times(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """stop_times (trip_id) of trips (trip_id, route_id) of routes (route_id): two semi joins, no row is multiplied."""
    return stop_times.join(trips.join(routes.select("route_id"), "route_id", "left_semi").select("trip_id"), "trip_id", "left_semi")


def ranked_subjects(rows: DataFrame, seeds: DataFrame, base: DataFrame) -> DataFrame:
    """Ranking rows (row_id, subject_id) with the subject's name from seeds, else from the base catalog (both subject_id, name):
    row_id, subject, origin (seed, base, or null where neither has it)."""
    one = lambda df, name: df.groupBy("subject_id").agg(F.min("name").alias(name))
    met = rows.join(one(seeds, "_seed"), "subject_id", "left").join(one(base, "_base"), "subject_id", "left")
    origin = F.when(F.col("_seed").isNotNull(), "seed").when(F.col("_base").isNotNull(), "base")
    return met.select("row_id", F.coalesce("_seed", "_base").alias("subject"), origin.alias("origin"))


def incomplete_sets(parts: dict[str, DataFrame]) -> DataFrame:
    """Stems (stem) that some of the named parts have and others lack: stem, finding (missing-<part>), a row per lack."""
    names = list(parts)
    every = None
    for name in names:
        one = parts[name].select("stem", F.lit(name).alias("part")).distinct()
        every = one if every is None else every.unionByName(one)
    have = every.groupBy("stem").agg(F.collect_set("part").alias("have"))
    lack = F.array_except(F.array(*map(F.lit, names)), F.col("have"))
    return have.select("stem", F.explode(F.transform(lack, lambda p: F.concat(F.lit("missing-"), p))).alias("finding"))


def checked_files(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Listed digests (path, sha) against found ones: path, status pass, mismatch, missing or unlisted."""
    met = listed.select("path", F.col("sha").alias("_want")).join(found.select("path", F.col("sha").alias("_have")), "path", "full_outer")
    status = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unlisted").when(F.col("_want") == F.col("_have"), "pass").otherwise("mismatch")
    return met.select("path", status.alias("status"))


def stage_lineage(raw: DataFrame, key: str, stages: dict[str, DataFrame], lost: dict[str, str], emitted: str = "emitted") -> DataFrame:
    """raw with status: `emitted` where the last stage has its key, else what `lost` says of the first stage that lacks it.
    Stages are tables of keys, in the order of the work."""
    status, met = F.lit(emitted), raw
    for name, rows in stages.items():
        met = met.join(rows.select(key, F.lit(True).alias(f"_{name}")).distinct(), key, "left")
    for name in reversed(stages):
        status = F.when(F.col(f"_{name}").isNull(), lost[name]).otherwise(status)
    return met.withColumn("status", status).drop(*[f"_{name}" for name in stages])


def first_source(df: DataFrame, key: str, sources: dict[str, Column], value: str, absent: str) -> DataFrame:
    """The value of the first of several sources that has one, and which it was: key, value, origin."""
    origin = F.lit(absent)
    for name, column in reversed(sources.items()):
        origin = F.when(column.isNotNull(), name).otherwise(origin)
    return df.select(key, F.coalesce(*sources.values()).alias(value), origin.alias("origin"))


def patched(records: DataFrame, patch: DataFrame, key: str, value: str) -> DataFrame:
    """records' value where a patch (key, value) has no other; patched says whether the patch knows the record at all."""
    new = patch.select(key, F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    return records.join(new, key, "left").withColumn(value, F.coalesce("_new", value)).withColumn("patched", F.coalesce("_hit", F.lit(False))).drop("_new", "_hit")


def alias_identity(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """Records (record, alias) by exact alias of identities (identity, alias): the identity where it is one, else conflict."""
    each = aliases.groupBy("alias").agg(F.min("identity").alias("_low"), F.max("identity").alias("_high"))  # an alias of many identities is one row
    low, high = F.min("_low"), F.max("_high")
    return records.join(each, "alias").groupBy("record").agg(F.when(low == high, low).alias("identity"), F.coalesce(low < high, F.lit(False)).alias("conflict"))


def numbered_pieces(df: DataFrame, group: list, order: list, label: Column) -> DataFrame:
    """Adds piece: a label of its own for every row of a group: the label, then label-2, label-3, .. in order."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_n", n).withColumn("piece", F.concat(label, F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""))).drop("_n")


def merged_manifests(entries: DataFrame) -> DataFrame:
    """Entries (id, body, failed) of several manifests: id, copies and status: merged where all good bodies agree, conflict where
    they don't, failed where there is none."""
    ok = entries.where("not failed").groupBy("id").agg(F.count("*").alias("copies"), F.when(F.countDistinct("body") > 1, "conflict").otherwise("merged").alias("status"))
    lost = entries.where("failed").select("id").distinct().join(ok, "id", "left_anti")
    return ok.unionByName(lost.select("id", F.lit(0).cast("long").alias("copies"), F.lit("failed").alias("status")))


def inventory_difference(want: DataFrame, have: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """side, k: keys (k) wanted and missing, and keys that are there but neither wanted nor, if given, allowed."""
    extra = have.subtract(want if allowed is None else allowed)
    return want.subtract(have).select(F.lit("missing").alias("side"), "k").unionByName(extra.select(F.lit("extra").alias("side"), "k"))


def same_features(rows: DataFrame, group: list[str], a: str, b: str, pos: str) -> DataFrame:
    """Features of a group with the same two ends, in either direction, as one: p, q, first_pos and copies."""
    ends = F.least(a, b).alias("p"), F.greatest(a, b).alias("q")
    return rows.select(*group, *ends, F.col(pos).alias("_pos")).groupBy(*group, "p", "q").agg(F.min("_pos").alias("first_pos"), F.count("*").alias("copies"))


def observations(rows: DataFrame, key: list[str], source: str, fact: str) -> DataFrame:
    """Repeated observations of a key as one: seen, provenance (its sources in order) and disagree, where a fact differs. What is
    gathered is one key's sources."""
    provenance = F.array_join(F.array_sort(F.collect_list(source)), ",")
    return rows.groupBy(*key).agg(F.count("*").alias("seen"), provenance.alias("provenance"), (F.countDistinct(fact) > 1).alias("disagree"))


def complementary(rows: DataFrame, key: str, kind: str, parts: int = 2) -> DataFrame:
    """Whether a key has its parts complete: as many rows as parts, each of a kind of its own."""
    n, kinds = F.count("*"), F.countDistinct(kind)
    return rows.groupBy(key).agg(n.alias("parts"), kinds.alias("kinds"), ((n == parts) & (kinds == parts)).alias("complete"))


def externalised(documents: DataFrame, key: str, value: str, pattern: str) -> DataFrame:
    """Documents before and after parts that match a pattern are taken out: digests of both, and how many parts went."""
    before, after = F.sha2(value, 256), F.sha2(F.regexp_replace(value, pattern, ""), 256)
    return documents.select(key, before.alias("before_sha"), after.alias("after_sha"), F.size(F.regexp_extract_all(value, F.lit(pattern), 0)).alias("removed"))


def contiguous_walks(edges: DataFrame, walk: str, order: Column) -> DataFrame:
    """Per walk its edges (a, b) and whether, in order, each begins where the one before ended."""
    following = F.lead("a").over(Window.partitionBy(walk).orderBy(order))
    return edges.withColumn("_next", following).groupBy(walk).agg(F.count("*").alias("edges"), (F.count_if(F.col("_next") != F.col("b")) == 0).alias("contiguous"))


def below_gate(df: DataFrame, size: str, gate: Column) -> DataFrame:
    """Rows left out for being below a gate, with the gate: the evidence for each omission."""
    return df.withColumn("gate", gate).where(F.col(size) < F.col("gate"))


def distance_gate(parts: DataFrame, course: str, length: str, kind: str, official: float, tolerance: float, least_kinds: int) -> DataFrame:
    """Per course the measured sum, and whether it is within a share of the official length with enough kinds of parts."""
    total = F.sum(length)
    near = F.abs(total - official) / official <= tolerance
    return parts.groupBy(course).agg(total.alias("measured"), (near & (F.countDistinct(kind) >= least_kinds)).alias("passed"))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def bound_content(rows: DataFrame, pinned: DataFrame, key: str) -> DataFrame:
    """rows (key, size, sha) against what a cohort pins (the same): key, status bound, size or digest. Contents stay where they
    are; sizes and digests are joined."""
    met = rows.select(key, "size", "sha").join(pinned.select(key, F.col("size").alias("_size"), F.col("sha").alias("_sha")), key)
    return met.select(key, F.when(F.col("size") != F.col("_size"), "size").when(F.col("sha") != F.col("_sha"), "digest").otherwise("bound").alias("status"))


def crews(rows: DataFrame, crew: str, seat: str, person: str, seats: int) -> DataFrame:
    """Per crew whether every seat is taken, and whether a person sits twice."""
    return rows.groupBy(crew).agg((F.countDistinct(seat) == seats).alias("complete"), (F.countDistinct(person) < F.count("*")).alias("repeated"))


def to_resume(plan: DataFrame, done: DataFrame, identity: list[str]) -> DataFrame:
    """Planned rows that no completed row with the same identity (its item and the digest of its input) covers."""
    return plan.join(done.select(*identity), identity, "left_anti")


def digest_of_set(df: DataFrame, group: list[str], digest: Column, buckets: int = 4096) -> DataFrame:
    """group, digest: one SHA-256 for each group's set of row digests (hex), alike for any order of rows.

    Row digests are dealt to buckets by their first characters; a bucket's digest is that of its sorted rows, the group's
    that of its buckets' in order. So a task holds a bucket of a group at a time, not the group."""
    width = max(1, (buckets - 1).bit_length() // 4)
    rows = df.select(*group, digest.alias("_d")).withColumn("_b", F.substring("_d", 1, width))
    each = rows.groupBy(*group, "_b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), "\n"), 256).alias("_s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_s"))), lambda x: x["_s"]), "\n")
    return each.groupBy(*group).agg(F.sha2(joined, 256).alias("digest"))
