"""SpotSigs fingerprints: chains of content words after common words, compared by pruned Jaccard; DataFrame functions only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone.llm.shared import partitions

#: Common words of the four languages, the anchors of chains.
ANCHORS = """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their
they this to was were which will with you au aux ce dans de des du elle en est et il la le les leur ne pas plus pour qui que
se son sur un une aber als auch auf aus bei das dem den der des die ein eine einer er es für hat ich im ist mit nach nicht
noch sich sie so und von war werden wie wir zu zum al como con del el ella era esta las lo los más no o para pero por se sin
su una y ya""".split()
#: Content words of a chain.
CHAIN = 3


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct 64-bit signatures of a text: for each common word, the next `chain` words that aren't common.

    A text that has no such chain is signed at every word by up to `chain` words from there; one without words by itself;
    an empty (or null) text has no signature.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    marked = F.regexp_replace(plain, " (?:" + "|".join(sorted(set(anchors))) + ")(?= )", " |")
    chains = F.regexp_extract_all(marked, F.lit(r"\|(?=((?:[ |]+[^ |]+){%d}))" % chain), 1)
    loose = F.regexp_extract_all(plain, F.lit(r" (?=([^ ]+(?: [^ ]+){0,%d}))" % (chain - 1)), 1)
    return F.struct(chains.alias("chains"), F.when(F.size(chains) == 0, loose).alias("loose"))


def fingerprint(found: Column, text: Column) -> Column:
    """The signatures of found, a signatures() column: kept apart so that it is computed once."""
    hashes = F.transform(F.when(F.size(found["chains"]) > 0, found["chains"]).otherwise(found["loose"]), lambda s: F.xxhash64(F.trim(F.regexp_replace(s, "[ |]+", " "))))
    whole = F.when(F.length(text) > 0, F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(F.when(F.size(hashes) > 0, hashes).otherwise(whole)))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.withColumn("_sig", signatures(F.coalesce(F.col(text), F.lit("")))).withColumn(name, fingerprint(F.col("_sig"), F.coalesce(F.col(text), F.lit("")))).drop("_sig")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Likeness of two sets (two empty ones: 1). Sets whose sizes alone keep it below `least` aren't intersected and get 0."""
    small, large = F.least(F.size(a), F.size(b)).cast("double"), F.greatest(F.size(a), F.size(b)).cast("double")
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(large == 0, 1.0).when((small == 0) | (small / large < least), 0.0).otherwise(shared / (small + large - shared))


def show(prints: str) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.lower(F.hex(x))), " ")


def length_class(size: Column, least: float) -> Column:
    """Partitions of set sizes: sets that reach `least` are in the same class or in neighbours."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(least))).cast("int")


def similar_pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs of different fingerprints of likeness `least` or more, and membership: (a, b, likeness) and (doc_id, id).

    Documents with equal fingerprints share a representative (the least doc_id), and only representatives are joined.
    Sets are partitioned by length; within a class and its upper neighbour they meet on their rarest signatures only (as
    many as two sets of that likeness can't both avoid), and the likeness is computed in full. Texts without signatures
    have no pairs. No pair is lost, none is capped.
    """
    prints = with_fingerprint(docs.select("doc_id", "text"), "text", "prints").select("doc_id", "prints", F.sha2(show("prints"), 256).alias("key"))
    groups = prints.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("prints").alias("prints"))
    members = prints.join(groups.select("key", "id"), "key").select("doc_id", "id")
    sets = groups.where(F.size("prints") > 0).select("id", "prints", F.size("prints").alias("n"), length_class(F.size("prints"), least).alias("c"))
    often = sets.select("id", F.explode("prints").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    ranked = sets.select("id", "n", "c", F.explode("prints").alias("s")).join(often, "s")
    order = F.row_number().over(Window.partitionBy("id").orderBy("df", "s"))
    prefix = ranked.withColumn("r", order).where(F.col("r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select("id", "n", "c", "s")
    left = prefix.select("s", F.col("id").alias("a"), F.col("n").alias("na"), F.explode(F.array("c", F.col("c") + 1)).alias("c"), F.col("c").alias("ca"))
    right = prefix.select("s", F.col("id").alias("b"), F.col("n").alias("nb"), "c")
    fits = (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9) & ((F.col("ca") < F.col("c")) | (F.col("a") < F.col("b")))
    met = left.join(right, ["s", "c"]).where(fits).select("a", "b").distinct()
    both = met.join(sets.select(F.col("id").alias("a"), F.col("prints").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("prints").alias("y")), "b")
    pairs = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), jaccard(F.col("x"), F.col("y"), least).alias("likeness")).where(F.col("likeness") >= least)
    return pairs, members


def with_next(docs: DataFrame, make) -> DataFrame:
    """docs (doc_id, text) with make() applied, and for each row the next row's columns as next_*: ascending doc_id (null
    first, equal ids by text hash), after the last row the first.

    Rows are dealt to ranges of doc_id, whose bounds are ids that exist; the first row of each range is dealt once more, to
    the range before, so a window over one range finds every successor and texts are shuffled once. The bounds, a few for
    each partition, are one array value in the plan, not an expression each.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"))
    count = 4 * partitions(spark)
    step = math.isqrt(count) + 1
    shares = F.percentile_approx("k", F.lit(np.arange(count) / count), 100_000)
    bounds = np.unique(np.array(keyed.agg(shares).head()[0] or [0], np.int64))
    every, rough = F.lit(bounds), F.lit(bounds[step::step])
    fine = keyed.withColumn("coarse", F.size(F.filter(rough, lambda b: b <= F.col("k"))))
    fine = fine.withColumn("bucket", F.col("coarse") * step + F.size(F.filter(F.slice(every, F.col("coarse") * step + 1, step), lambda b: b <= F.col("k"))) - 1)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(bounds))).alias("bucket"), F.lit(True).alias("copy"))
    dealt = fine.withColumn("at", F.explode(F.when(F.element_at(every, F.col("bucket") + 1) == F.col("k"), F.array(own, before)).otherwise(F.array(own))))
    ranged = make(dealt.select("doc_id", "text", "k", F.col("at.bucket").alias("bucket"), F.col("at.copy").alias("copy")).repartition(partitions(spark), "bucket"))
    order = Window.partitionBy("bucket").orderBy("copy", "k", F.xxhash64("text"), "text")
    added = [c for c in ranged.columns if c not in ("doc_id", "k", "bucket", "copy")]
    return ranged.withColumns({f"next_{c}": F.lead(c).over(order) for c in added}).where(~F.col("copy")).drop("k", "bucket", "copy")


def edited_report(docs: DataFrame) -> DataFrame:
    """Per row: the fingerprint of the text and of its edited text, and their likeness, as op9's contract has it."""
    rows = with_next(docs, lambda df: with_fingerprint(df, "text", "prints"))
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))})
    rows = with_fingerprint(rows, "edited", "edited_prints")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), show("prints").alias("fingerprint"), show("edited_prints").alias("edited_fingerprint"), jaccard(F.col("prints"), F.col("edited_prints")).alias("near_edited"), jaccard(F.col("prints"), F.col("next_prints")).alias("near_next"))
