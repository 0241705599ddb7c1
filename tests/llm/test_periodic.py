"""Periodic runs against the definition, word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from tests.llm.test_llm import docs_of
from waystone.llm import periodic


def plain_runs(w):
    """Every run by trying every period at every place."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, size = i, j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(s, s + size - r)) for r in range(1, q)):
                out.add((s, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def odd_texts():
    rng = random.Random(4)
    texts = ["", " ", None, "a", "a a a a a", "a a a a a a", "a b " * 4, "a b a b a b a", "a a a a a a b b b b b b", "x " + "a b c " * 6 + "a b", "\x1fa \x1fa \x1fa \x1fa \x1fa \x1fa", "a b " * 9, "a\tb\r\na b\x0ba b\x0ca b"]
    for _ in range(120):
        n, letters = rng.randrange(120), rng.choice([1, 2, 3, 9, 40])
        w = [str(rng.randrange(letters)) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 25)
            w = w[:a] + (w[a : a + p] * n)[: n - a]
        if n and rng.random() < 0.3:
            w[rng.randrange(n)] = "odd"
        texts.append(rng.choice([" ", "  ", "\n"]).join(w))
    return texts


def test_runs_equal_the_definition(spark):
    texts = odd_texts()
    ids = [*range(len(texts))]
    ids[3] = ids[4] = 2  # equal ids
    rows = [(i, t) for i, t in zip(ids, texts, strict=True)] + [(None, "a b a b a b a b a b"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as start", "'x' as period").repartition(3)
    got = periodic.periodic_runs(df).drop("runs").collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(i, t) for i, t in rows), key=str)
    assert sum(r["n_runs"] > 1 for r in got) > 10


def test_no_rows_and_names(spark):
    out = periodic.periodic_runs(docs_of(spark, ["a b"]).limit(0))
    assert out.count() == 0 and out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]


def test_long_runs_take_linear_time():
    """A text of 300,000 equal words, one of 60,000 words repeated five times, and one of many short runs."""
    w = [f"w{i}" for i in range(60_000)]
    got = periodic.block_runs([["a"] * 300_000, w * 5, [x for i in range(30_000) for x in ("a",) * 6 + (f"b{i}",)]])
    assert got[0] == [(0, 300_000, 1)] and got[1] == [(0, 300_000, 60_000)]
    assert got[2] == [(7 * i, 6, 1) for i in range(30_000)]


def test_documents_of_a_block_do_not_meet():
    assert periodic.block_runs([["a"] * 3, ["a"] * 3, [], ["a"] * 6]) == [[], [], [], [(0, 6, 1)]]


def test_ties_of_exponent():
    runs = [(9, 12, 2), (3, 6, 1), (0, 12, 2), (20, 7, 2)]
    from functools import cmp_to_key

    assert min(runs, key=cmp_to_key(periodic._compare)) == (0, 12, 2)
    near = [(0, 10**9 + 1, 10**8), (5, 10**9 * 3 + 4, 3 * 10**8)]  # 10.00000001 and 10.0000000133
    assert min(near, key=cmp_to_key(periodic._compare)) == near[1]
