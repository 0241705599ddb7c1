"""Checks as rows: every rule that a row breaks is one row of a report, nothing is raised unless asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waystone.operators.storage import settled, union_all


def findings(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row (key, reason) for each rule that holds. A rule that is null doesn't hold."""
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(*key, F.explode(reasons).alias("reason"))


def partition_parity(whole: DataFrame, kept: DataFrame, dropped: DataFrame, key: str, size: str) -> DataFrame:
    """One row: whether kept and dropped together are the whole, without overlap, with equal sums. size sums are rounded."""
    parts = kept.select(key, size).unionByName(dropped.select(key, size))
    lost, added = whole.select(key).exceptAll(parts.select(key)), parts.select(key).exceptAll(whole.select(key))
    both = kept.select(key).intersect(dropped.select(key))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    total = lambda df, name: df.agg(F.round(F.sum(size), 6).alias(name))
    out = count(lost, "lost").crossJoin(count(added, "added")).crossJoin(count(both, "overlap")).crossJoin(total(whole, "whole_sum")).crossJoin(total(parts, "parts_sum"))  # one row each
    return out.withColumn("holds", (F.col("lost") == 0) & (F.col("added") == 0) & (F.col("overlap") == 0) & (F.col("whole_sum") == F.col("parts_sum")))


def agreement(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """The value that two sources agree on; withheld where they differ, single where only one has it."""
    status = F.when(F.col(a).isNull() & F.col(b).isNull(), "absent").when(F.col(a).isNull() | F.col(b).isNull(), "single").when(F.col(a) == F.col(b), "agreed").otherwise("withheld")
    return df.select(key, F.when(status != "withheld", F.coalesce(a, b)).alias("value"), status.alias("status"))


def moved(before: DataFrame, after: DataFrame, identity: list[str]) -> DataFrame:
    """Rows whose identity columns are in one version only: (identity, side)."""
    b, a = before.select(*identity), after.select(*identity)
    return b.exceptAll(a).withColumn("side", F.lit("gone")).unionByName(a.exceptAll(b).withColumn("side", F.lit("new")))


def strict(report: DataFrame) -> DataFrame:
    """The report, if it is empty; an error with its first rows otherwise."""
    first = report.limit(5).collect()
    if first:
        raise ValueError(f"{first}")
    return report


def raw_geometry(elements: DataFrame, canonical: DataFrame | None = None, nodes_given: bool = True) -> DataFrame:
    """Findings (id, type, reason) on raw elements: type, id, lat, lon, nodes (array of ids), geometry (array of struct(lat, lon)),
    members (array of struct(type, ref, role)). A row per rule that an element breaks:

    unknown-type, no-id, repeated-id; no-coordinates and coordinate-range (nodes); too-few-vertices, vertex-missing,
    vertex-range, zero-length and node-count (ways: geometry and nodes of different length); node-missing (a way's node that
    isn't there); no-members, member-type, member-role, member-missing, member-repeated and member-cycle (a relation that
    leads back to itself) on relations. An extract that holds geometry inline and no nodes is told by nodes_given=False: its ways'
    references can't be followed and none is missing. canonical-changed where canonical (type, id, digest) has another digest of the
    geometry, canonical-lost where it has an element that isn't there.
    """
    from waystone.operators.graph import reachable_from_itself

    elements = settled(elements)  # every rule below reads them
    inside = lambda lat, lon: lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    g, way, node, relation = F.col("geometry"), F.col("type") == "way", F.col("type") == "node", F.col("type") == "relation"
    known = F.coalesce(F.col("type").isin("node", "way", "relation"), F.lit(False))
    vertex = lambda f: F.coalesce(F.exists(g, f), F.lit(False))
    member = lambda f: F.coalesce(F.exists("members", f), F.lit(False))
    refs = F.transform("members", lambda m: F.struct(m["type"], m["ref"], m["role"]))
    rules = {
        "unknown-type": ~known,
        "no-id": F.col("id").isNull(),
        "no-coordinates": node & (F.col("lat").isNull() | F.col("lon").isNull()),
        "coordinate-range": node & ~inside(F.col("lat"), F.col("lon")),
        "too-few-vertices": way & (F.coalesce(F.size(g), F.lit(0)) < 2),
        "vertex-missing": way & vertex(lambda p: p.isNull() | p["lat"].isNull() | p["lon"].isNull()),
        "vertex-range": way & vertex(lambda p: ~inside(p["lat"], p["lon"])),
        "zero-length": way & (F.size(g) >= 2) & (F.size(F.array_distinct(g)) == 1),
        "node-count": way & F.col("nodes").isNotNull() & (F.size("nodes") != F.size(g)),
        "no-members": relation & (F.coalesce(F.size("members"), F.lit(0)) < 1),
        "member-type": relation & member(lambda m: ~F.coalesce(m["type"].isin("node", "way", "relation"), F.lit(False))),
        "member-role": relation & member(lambda m: m["role"].isNull()),
        "member-repeated": relation & (F.size(refs) != F.size(F.array_distinct(refs))),
    }
    found = [findings(elements, ["type", "id"], rules)]
    once = settled(elements.where(known & F.col("id").isNotNull()).groupBy("type", "id").agg(F.count("*").alias("n")))
    report = lambda df, reason: df.select("type", "id", F.lit(reason).alias("reason")).distinct()
    found.append(report(once.where("n > 1"), "repeated-id"))
    needs = elements.where(way).select("type", "id", F.explode("nodes").alias("ref")).withColumn("kind", F.lit("node"))
    asks = elements.where(relation).select("type", "id", F.explode("members").alias("m")).select("type", "id", F.col("m.ref").alias("ref"), F.col("m.type").alias("kind"))
    there = once.select(F.col("type").alias("kind"), F.col("id").alias("ref"))
    if nodes_given:
        found.append(report(needs.join(there, ["kind", "ref"], "left_anti"), "node-missing"))
    found.append(report(asks.where("kind in ('way', 'relation')").join(there, ["kind", "ref"], "left_anti"), "member-missing"))
    nested = asks.where("kind = 'relation'").select(F.col("id").alias("a"), F.col("ref").alias("b"))
    if not nested.isEmpty():
        found.append(reachable_from_itself(nested).select(F.lit("relation").alias("type"), "id", F.lit("member-cycle").alias("reason")))
    if canonical is not None:
        now = elements.where(way).select("type", "id", geometry_digest(g).alias("_now"))
        met = canonical.join(now, ["type", "id"], "left")
        found += [report(met.where("_now is null"), "canonical-lost"), report(met.where("_now <> digest"), "canonical-changed")]
    return union_all(found)


def geometry_digest(geometry: Column) -> Column:
    """SHA-256 of a geometry's vertices at seven decimals, in order."""
    return F.sha2(F.array_join(F.transform(geometry, lambda p: F.format_string("%.7f %.7f", p["lon"], p["lat"])), ";"), 256)
