"""Personal data: base patterns, and identifiers that bootstrapped lexical patterns find."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waystone.llm.shared import spent, written

#: Kinds in the order that breaks ties; the last one is what the lexical patterns add.
KINDS = ("email", "ip", "card", "phone", "context")
#: The base patterns, written so that no text takes more than linear time, and their limits.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, GREATEST_PART = (14, 19), (10, 15), 255
#: What could be an identifier: a longest run of these characters without the marks at its ends, of DIGITS digits or more and at
#: most LONGEST characters.
DIGIT, RUN = re.compile("[0-9]"), re.compile("[A-Za-z0-9._/:@-]+")
RUN_CHARS, EDGE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._/:@-"), "._/:@-"
DIGITS, LONGEST = 4, 64
#: Words that a lexical pattern looks at are cut from so many characters on each side of a mention.
REACH = 96
WORD = re.compile(r"\w+|[^\w\s]+")
#: A pattern needs so many different seed instances, and this confidence to say something; rounds of the graph.
LEAST_SEEDS, CONFIDENT, ROUNDS = 3, 0.8, 4

_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit holds: every second digit from the right but one is doubled, and its digits are added."""
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            free = found.end()
            out.append((start, free))
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans (start, kind, end) by start and kind: per kind leftmost matches that don't overlap, without failing ones."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= GREATEST_PART for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 2 * CARD_DIGITS[1]:
            digits = _NOT_DIGIT.sub("", m[0])
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if PHONE_DIGITS[0] <= len(_NOT_DIGIT.sub("", m[0])) <= PHONE_DIGITS[1]:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places of what could be an identifier and meets no taken span (sorted by start)."""
    out, k, end, found = [], 0, 0, DIGIT.search(text)
    while found:
        first, last = found.start(), RUN.match(text, found.start()).end()
        found = DIGIT.search(text, last)
        while first > 0 and last - first <= 2 * LONGEST and text[first - 1] in RUN_CHARS:
            first -= 1
        run = text[first:last]
        start, stop = first + len(run) - len(run.lstrip(EDGE)), last - len(run) + len(run.rstrip(EDGE))
        if stop - start > LONGEST or len(_NOT_DIGIT.sub("", run)) < DIGITS:
            continue
        while k < len(taken) and taken[k][0] < stop:
            end = max(end, taken[k][2])
            k += 1
        if end <= start:
            out.append((start, stop))
    return out


def _key(*parts: str) -> bytes:
    return hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=12).digest()


def patterns(text: str, start: int, end: int) -> list[bytes]:
    """Keys of the lexical patterns of a mention: the three words before it, the two before it, and one on each side; case and
    digits don't matter. A pattern that would reach past the text's start isn't there."""
    before = [w.lower() for w in WORD.findall(text[max(0, start - REACH) : start])[-3:]]
    after = [w.lower() for w in WORD.findall(text[end : end + REACH])[:1]]
    out = [_key("l", *before[-k:]) for k in (3, 2) if len(before) >= k]
    return out + ([_key("s", before[-1], after[0])] if before and after else [])


def instance(text: str) -> bytes:
    return _key("i", "".join(c for c in text.lower() if c.isalnum()))


def scanned(docs: DataFrame, name: str = "mentions") -> DataFrame:
    """A table: row (one per row of docs), doc_id, base (start, kind, end) and mentions (start, end, seed, instance, patterns).

    A row's number is that of its task and its place in it; the table keeps it whatever is lost later. Instances and patterns
    are keys, so that no personal data are written."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        mention = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.binary()), ("patterns", pa.list_(pa.binary()))])
        for batch in batches:
            n = batch.num_rows
            texts = batch.column("text")
            bases, mentions = [], []
            for i in range(n):
                text = texts[i].as_py() or ""
                base = base_spans(text)
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                places = [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in candidates(text, base)]
                mentions.append([{"start": a, "end": b, "seed": s, "instance": instance(text[a:b]), "patterns": patterns(text, a, b)} for a, b, s in places])
            columns = [pa.array(range(row, row + n), pa.int64()), batch.column("doc_id"), pa.array(bases, pa.list_(span)), pa.array(mentions, pa.list_(mention))]
            row += n
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "base", "mentions"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = "base array<struct<start: int, kind: int, end: int>>, mentions array<struct<start: int, end: int, seed: boolean, instance: binary, patterns: array<binary>>>"
    return written(docs.select("doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, {found}"), name)


def _confident(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Patterns (pattern, confidence) that are confident: the mean score of their instances, with half an instance more that
    scores nothing, given that LEAST_SEEDS of the instances are seeds."""
    met = edges.join(scores, "instance", "left")
    worth = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    sums = met.groupBy("pattern").agg(F.sum(worth).alias("worth"), F.count("*").alias("n"), F.sum(F.col("seed").cast("long")).alias("seeds"))
    confidence = F.col("worth") / (F.col("n") + 0.5)
    return sums.where(F.col("seeds") >= LEAST_SEEDS).select("pattern", confidence.alias("confidence")).where(F.col("confidence") >= CONFIDENT)


def discovered(scan: DataFrame) -> DataFrame:
    """Instances (instance, score) that aren't seeds and that confident patterns speak for.

    The graph has an edge for each pattern and instance that were met together, once, however often: copies count as one.
    A pattern is as confident as its instances score on the mean; an instance that isn't a seed scores what its confident
    patterns leave of doubt: 1 - the product of 1 - confidence. ROUNDS rounds at most; both sides meet by exchange."""
    flat = scan.select(F.explode("mentions").alias("m")).select("m.instance", "m.seed", F.explode("m.patterns").alias("pattern"))
    edges = written(flat.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    crowded = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("long")).alias("s"), F.count("*").alias("c")).where((F.col("s") >= LEAST_SEEDS) & (F.col("c") > F.col("s")))
    # patterns without LEAST_SEEDS seeds never speak, and those of seeds alone have nobody to speak for
    live = written(edges.join(crowded.select("pattern"), "pattern", "left_semi"), "edges")
    spent(edges)
    scores = written(live.select("instance", F.lit(0.0).alias("score")).limit(0), "scores")
    before = -1.0
    for _ in range(ROUNDS):
        speaking = _confident(live, scores)
        doubt = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        told = live.where("not seed").join(speaking, "pattern").groupBy("instance").agg(F.round(1 - doubt, 9).alias("score"))
        after = written(told, "scores")
        total = after.agg(F.coalesce(F.sum("score"), F.lit(0.0)), F.count("*")).first()
        spent(scores)
        scores = after
        if total == before:
            break
        before = total
    spent(live)
    return scores


def _by(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def find_personal(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, base and spans, arrays of (start, kind, end) in code points by start and kind.

    Base spans are seeds. The words around them are lexical patterns; patterns and what they surround form a graph that is
    scored in rounds, and what a confident pattern surrounds elsewhere, and could be an identifier by its characters, is a span
    of kind 4 (context) wherever it stands and meets no base span. Null and empty texts have no spans; equal rows get equal
    spans; a null doc_id is passed on; a row is known by its own number, so repeated ids don't matter; an empty table gives no
    rows; other columns aren't read. Only mentions are exchanged, never texts."""
    scan = scanned(docs)
    scores = discovered(scan).where(F.col("score") >= CONFIDENT).select("instance")
    mentions = scan.select("row", F.explode("mentions").alias("m")).where("not m.seed").select("row", "m.instance", "m.start", "m.end")
    span = F.struct("start", F.lit(4).alias("kind"), "end")
    added = mentions.join(scores, "instance").groupBy("row").agg(F.collect_list(span).alias("added"))
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    return scan.join(added, "row", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def digest(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    counts = [_by(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return find_personal(docs).select("doc_id", *counts, F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"))
