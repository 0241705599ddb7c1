"""Secrets by pattern, and by a randomness test battery under length-aware false-discovery control; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waystone.llm.shared import either_case, written

#: The base kinds in the order that breaks ties, their patterns, and how many characters count.
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(map(either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS, ACCESS, HEX = 6, r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: Runs of at least 20 characters that an encoding could have made.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings: name, what a token must look like, and the alphabet in the order of its values.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    ("base62", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("base36", r"^(?=.*[0-9])(?=.*[g-z])[0-9a-z]+$", DIGITS + LOWER),
)
#: p-values are kept as one of BINS equal bins; a stratum is an encoding and an octave of lengths (at most OCTAVES).
BINS, OCTAVES = 100, 12
#: Characters of the chunks that a text is cut into where its spans are replaced.
CUT = 1024
#: Accepted share of tokens that aren't random among those reported, and the least p-value of a random token.
FALSE_SHARE, LEAST_P = 0.05, 0.01


def _running(items: Column, zero: Column, add, meet, give) -> Column:
    """give(x, acc) for each x of items, acc being add() of all before it, from zero on. meet(acc, acc2) adds up two of them.

    An array that grows by one in each step of a fold is copied each time. So items are cut into blocks of about the cube
    root of their number, blocks are added up, and each block starts from what the blocks before it hold: n items take about
    n^(4/3) copies."""

    def in_blocks(v: Column) -> Column:
        block = F.greatest(F.lit(1), F.ceil(F.cbrt(F.size(v).cast("double"))).cast("int"))
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), block)
        return F.transform(starts, lambda a: F.slice(v, a, block))

    def appended(of: Column, start: Column, after, one) -> Column:
        none = F.filter(F.transform(F.slice(of, 1, 1), lambda x: one(x, zero)), lambda x: F.lit(False))
        first = F.struct(start.alias("acc"), none.alias("out"))
        step = lambda s, x: F.struct(after(s["acc"], x).alias("acc"), F.concat(s["out"], F.array(one(x, s["acc"]))).alias("out"))
        return F.aggregate(of, first, step, lambda s: s["out"])

    def whole(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, add))
        befores = _let(sums, lambda v: appended(v, zero, meet, lambda x, acc: acc))
        return F.flatten(F.zip_with(blocks, befores, lambda b, acc: appended(b, acc, add, give)))

    return _let(_let(items, in_blocks), whole)  # bound first: a lambda computes what it names anew in each step


def _found(matches: Column, rest: Column, keep, make) -> Column:
    """make(start, end, match) for each of the matches that keep() keeps; rest: the pieces of the text between them."""
    sizes = F.zip_with(F.slice(rest, 1, F.size(matches)), matches, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("n"), b.alias("m")))
    placed = _running(sizes, F.lit(0), lambda acc, x: acc + x["gap"] + x["n"], lambda a, b: a + b, lambda x, acc: F.struct((acc + x["gap"]).alias("start"), (acc + x["gap"] + x["n"]).alias("end"), x["m"].alias("m")))
    return F.transform(F.filter(placed, lambda x: keep(x["m"])), lambda x: make(x["start"], x["end"], x["m"]))


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z); the polynomial's constants are fixed values (absolute error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    q = F.exp(-a * a / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, q).otherwise(1 - q)


def _both_tails(z: Column) -> Column:
    return 2 * _upper_tail(F.abs(z))


def _let(value: Column, of) -> Column:
    """of(value), with value computed once: higher-order functions don't share common parts of their own accord."""
    return F.element_at(F.transform(F.array(value), of), 1)


def battery(token: Column, encoding: Column) -> Column:
    """A p-value for "token is random in its encoding's alphabet": chi-squared uniformity (Wilson and Hilferty's normal
    form), runs above and below the alphabet's middle, and lag-1 serial correlation; three times the least, at most 1."""
    alphabet = F.coalesce(*[F.when(encoding == i, F.lit(a)) for i, (_, _, a) in enumerate(ENCODINGS)])
    k = F.length(alphabet).cast("double")
    word = F.when(encoding == 0, F.lower(token)).otherwise(token)

    def statistics(v: Column) -> Column:
        x, n, mean = v["x"], v["n"], v["mean"]
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, a: s + F.pow(F.size(F.filter(x, lambda b: b == a)).cast("double"), F.lit(2.0)))
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(
            n.alias("n"),
            (squares * k / n - n).alias("chi"),
            F.aggregate(x, F.lit(0.0), lambda s, a: s + F.when(a * 2 >= k, 1.0).otherwise(0.0)).alias("high"),
            F.aggregate(pairs, F.lit(1.0), lambda s, p: s + F.when((p["a"] * 2 >= k) != (p["b"] * 2 >= k), 1.0).otherwise(0.0)).alias("runs"),
            F.aggregate(x, F.lit(0.0), lambda s, a: s + (a - mean) * (a - mean)).alias("spread"),
            F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean)).alias("joint"),
        )

    def scores(v: Column) -> Column:
        n, free = v["n"], k - 1
        chi = (F.cbrt(v["chi"] / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        expected = 2 * v["high"] * (n - v["high"]) / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        runs = F.when(variance > 0, (v["runs"] - expected) / F.sqrt(variance)).otherwise(F.lit(99.0))
        serial = F.when(v["spread"] > 0, (v["joint"] / v["spread"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        return F.struct(chi.alias("chi"), runs.alias("runs"), serial.alias("serial"))

    letters = F.filter(F.split(word, ""), lambda c: c != "")
    values = F.transform(letters, lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    mean = lambda x: F.struct(x.alias("x"), F.size(x).cast("double").alias("n"), (F.aggregate(x, F.lit(0.0), lambda s, a: s + a) / F.size(x)).alias("mean"))
    combined = lambda z: F.least(F.lit(1.0), 3 * F.least(_upper_tail(z["chi"]), _both_tails(z["runs"]), _both_tails(z["serial"])))
    return _let(_let(_let(_let(values, mean), statistics), scores), combined)


def scanned(docs: DataFrame) -> DataFrame:
    """Adds to docs: base (array of start, kind, end; kinds by number) and tokens (start, end, stratum, bin)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({"_m0": F.regexp_extract_all(text, F.lit(ASSIGN), 0), "_m1": F.regexp_extract_all(text, F.lit(ACCESS), 0), "_m2": F.regexp_extract_all(text, F.lit(HEX), 0), "_m3": F.regexp_extract_all(text, F.lit(CANDIDATE), 0)})

    def span(kind: int):
        return lambda start, end, m: F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))

    def place(name: str, pattern: str, keep, make):
        none = F.filter(F.array(make(F.lit(0), F.lit(0), F.lit(""))), lambda x: F.lit(False))
        return F.when(F.size(name) > 0, _found(F.col(name), F.split(text, pattern, -1), keep, make)).otherwise(none)

    def token(start, end, m):
        kind = F.coalesce(*[F.when(m.rlike(p), F.lit(i)) for i, (_, p, _) in enumerate(ENCODINGS)])
        return F.struct(start.alias("start"), end.alias("end"), kind.alias("encoding"), m.alias("m"))

    every = lambda m: F.lit(True)
    coded = lambda m: F.greatest(*[m.rlike(p) for _, p, _ in ENCODINGS])
    out = out.withColumns(
        {
            "base": F.array_sort(F.concat(place("_m0", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_CHARS, span(0)), place("_m1", ACCESS, every, span(1)), place("_m2", HEX, every, span(2)))),
            "_t": place("_m3", CANDIDATE, coded, token),
        }
    )
    octave = lambda t: F.least(F.floor(F.log2((t["end"] - t["start"]).cast("double"))), F.lit(OCTAVES - 1))
    tested = F.transform("_t", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), (t["encoding"] * OCTAVES + octave(t)).cast("int").alias("stratum"), F.least(F.floor(battery(t["m"], t["encoding"]) * BINS), F.lit(BINS - 1)).cast("int").alias("bin")))
    return out.withColumn("tokens", tested).drop("_m0", "_m1", "_m2", "_m3", "_t")


def thresholds(scan: DataFrame) -> dict[int, int]:
    """Per stratum the least bin whose tokens are reported; a stratum that has none is absent.

    Random tokens' p-values are uniform, so the upper half's count tells how many there are; what else lies above a bin
    is taken as false. The histogram has at most encodings x octaves x BINS rows, whatever the corpus.
    """
    bins = scan.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").count().collect()
    by: dict[int, list[int]] = {}
    for r in bins:
        by.setdefault(r["stratum"], [0] * BINS)[r["bin"]] = r["count"]
    out = {}
    for stratum, n in by.items():
        each = sum(n[BINS // 2 :]) / (BINS - BINS // 2)
        for b in range(int(LEAST_P * BINS), BINS // 2):
            above = sum(n[b:])
            if above and max(0.0, above - each * (BINS - b)) / above <= FALSE_SHARE:
                out[stratum] = b
                break
    return out


def _alone(tokens: str, base: str) -> Column:
    """Tokens that meet no base span. Both are sorted by start together: no base span before a token reaches into it, and the
    next one behind it begins at its end or later."""
    item = lambda own: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"))
    both = F.array_sort(F.concat(F.transform(base, item(False)), F.transform(tokens, item(True))))
    furthest = lambda acc, x: F.greatest(acc, F.when(x["own"], 0).otherwise(x["end"]))
    nearest = lambda acc, x: F.least(acc, F.when(x["own"], acc).otherwise(x["start"]))
    before = _running(both, F.lit(0), furthest, F.greatest, lambda x, acc: F.struct(*[x[c].alias(c) for c in ("start", "end", "own")], acc.alias("before")))
    after = _running(F.reverse(before), F.lit(2147483647), nearest, F.least, lambda x, acc: F.struct(*[x[c].alias(c) for c in ("start", "end", "own", "before")], acc.alias("after")))
    return F.filter(F.reverse(after), lambda x: x["own"] & (x["before"] <= x["start"]) & (x["after"] >= x["end"]))


def with_spans(scan: DataFrame, limits: dict[int, int]) -> DataFrame:
    """scan with spans instead of tokens: the base spans, and tokens that reach their stratum's bin and meet no base span."""
    if limits:
        least = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
        passed = F.filter("tokens", lambda t: F.coalesce(t["bin"] >= F.element_at(least, t["stratum"]), F.lit(False)))
    else:
        passed = F.filter("tokens", lambda t: F.lit(False))
    scan = scan.withColumn("_passed", passed)
    added = F.transform(_alone("_passed", "base"), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    none = F.filter("base", lambda b: F.lit(False))
    return scan.withColumn("spans", F.when(F.size("_passed") > 0, F.array_sort(F.concat("base", added))).otherwise(F.concat("base", none))).drop("tokens", "_passed")


def _rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs' rows as one struct beside their text, so that no name of theirs can clash."""
    kept = [F.col(f"`{c}`") for c in columns]
    return docs.select((F.struct(*kept) if kept else F.lit(None).cast("struct<>")).alias("_doc"), F.col("text"))


def find_secrets(docs: DataFrame, name: str = "scan") -> DataFrame:
    """Per row of docs: doc (a struct of its columns but text), base and spans: arrays of (start, kind, end) in code points.

    Base kinds are leftmost, non-overlapping matches per kind. A token that an encoding could have made, is random by the
    battery under its stratum's threshold, and meets no base span is a span of kind 3 (random). Null texts count as empty
    (no spans); equal rows get equal spans; other columns pass through, whatever they are called. Every row is scanned once
    by itself and the scan, without texts, is a table in the shared folder: no key is ever gathered.
    """
    scan = written(scanned(_rows(docs, [c for c in docs.columns if c != "text"])).drop("text"), name)
    return with_spans(scan, thresholds(scan)).withColumnRenamed("_doc", "doc")


def digest(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"))


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """text with mark in place of each stretch of spans that meet. Finding a place in a text takes time by the place, so the text
    is cut into chunks once, and what lies between two spans is cut from the chunks that hold it."""

    def between(chunks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / CUT).cast("int")
        held = F.slice(chunks, first + 1, F.floor((b - 1) / CUT).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(held, ""), (a - first * CUT + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    def rebuilt(chunks: Column) -> Column:
        part = lambda s, acc: F.when(s["start"] >= acc, F.concat(between(chunks, acc, s["start"]), F.lit(mark))).otherwise("")
        parts = _running(spans, F.lit(0), lambda acc, s: F.greatest(acc, s["end"]), F.greatest, part)
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), between(chunks, last, F.length(text)))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), 0), rebuilt)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by mark (spans that meet become one), n_chars counted anew if present.

    Texts are read twice, for the thresholds and for the spans, instead of being kept on disk in between; no row is joined,
    so equal ids and rows stay as they are."""
    columns = docs.columns
    scan = scanned(_rows(docs, columns))
    found = with_spans(scan, thresholds(scan))
    clean = F.when(F.size("spans") > 0, _marked(F.col("text"), F.col("spans"), mark))
    marked = found.withColumn("_clean", clean)
    changed = {"text": F.coalesce("_clean", "text")}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(F.col("_clean").isNotNull(), F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    return marked.select(*[changed.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in columns])
