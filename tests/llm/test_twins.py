"""The llm operators against plain Python that shares no code with them, and columns of any name."""

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

import public_tokenizers as P
from waystone.llm import language, order_minhash, packing, pieces, quality, secret_scan, spotsigs, wavelet

BYTE = P.path("byte_bpe_50k.json")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_votes_are_those_of_plain_neighbours():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdef ")) for _ in range(80)) for _ in range(90)] + ["", "x" * 200_000]
    m = quality.fit(quality.counted(texts[:60]), [i % 2 for i in range(60)])
    got = m.score(quality.counted(texts))
    vectors = m.embed(quality.counted(texts))
    for i, v in enumerate(vectors):
        near = sorted(((float(v @ u), k) for k, u in enumerate(m.vectors)), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(s, 0.0) ** quality.POWER for s, _ in near]
        want = sum(w * (k % 2) for w, (_, k) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) > 1e-12 else 0.5
        assert math.isclose(got[i], want, abs_tol=1e-3)
    assert np.allclose(m.score(quality.counted([texts[3]] * 2)), m.score(quality.counted([texts[3]]))[0], atol=1e-5)


def test_predictions_are_the_weighted_windows():
    rng = np.random.default_rng(5)
    f = [rng.standard_normal((w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS]
    m = language.Model(["a", "b", "c"], f, np.zeros(48, np.float32), rng.standard_normal((48, 3)).astype(np.float32) / 9, np.zeros(3, np.float32))
    texts = ["kurz", "é" * 400, "word " * 30_000, "kurz"]
    names, scores = m.predict(texts)
    for t, name, score in zip(texts, names, scores.tolist(), strict=True):
        data = t.encode()
        total = np.zeros(3)
        for a in range(0, len(data), language.WINDOW):
            w = np.frombuffer(data[a : a + language.WINDOW].ljust(language.WINDOW, b"\0"), np.uint8)
            size = language.WINDOW - 3
            peak = np.concatenate([np.maximum(sum(k[o][w[o : o + size]] for o in range(len(k))).max(axis=0), 0) for k in f])
            z = peak @ m.out
            total += (z - z.max() - np.log(np.exp(z - z.max()).sum())) * len(data[a : a + language.WINDOW])
        p = np.exp(total / len(data) - (total / len(data)).max())
        p /= p.sum()
        assert name == "abc"[int(p.argmax())] and math.isclose(score, p.max(), abs_tol=1e-3)


def plain_spots(text):
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    found = []
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            found += [" ".join(chain)] * (len(chain) == spotsigs.CHAIN)
    if not found:
        found = [" ".join(words[i : i + spotsigs.CHAIN]) for i in range(len(words))]
    return {xxhash.xxh64(x.encode(), seed=42).intdigest() for x in found or ([text] if text else [])}


def test_fingerprints_are_plain_spot_signatures(spark):
    rng = random.Random(2)
    words = ["the", "of", "and", "der", "und", "le", "fox", "river", "haus", "maison", "x9", "thé", "andy"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) + rng.choice([".", "!", "", "\n"]) for _ in range(150)] + ["", "???", "fox river haus", "THE Fox, river haus"]
    got = {r["doc_id"]: {x % 2**64 for x in r["p"]} for r in spotsigs.with_fingerprint(frame(spark, texts), "text", "p").collect()}
    assert got == {i: plain_spots(t) for i, t in enumerate(texts)}


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def plain_battery(token, alphabet):
    x = [alphabet.index(c) for c in token]
    n, k, mean = len(x), len(alphabet), sum(x) / len(x)
    chi = sum(c * c for c in Counter(x).values()) * k / n - n
    z1 = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    high = [2 * v >= k for v in x]
    h, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    expected = 2 * h * (n - h) / n + 1
    z2 = (runs - expected) / math.sqrt((expected - 1) * (expected - 2) / (n - 1))
    spread = sum((v - mean) ** 2 for v in x)
    z3 = (sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / spread + 1 / n) * math.sqrt(n)
    return min(1.0, 3 * min(tail(z1), 2 * tail(abs(z2)), 2 * tail(abs(z3))))


def test_battery_gives_plain_p_values(spark):
    rng = random.Random(9)
    rows = [("".join(rng.choices("0123456789abcdef", k=rng.randrange(24, 80))), 0) for _ in range(60)]
    got = [r["p"] for r in spark.createDataFrame(rows, "t string, e int").select(secret_scan.battery(F.col("t"), F.col("e")).alias("p")).collect()]
    assert all(math.isclose(p, plain_battery(t, "0123456789abcdef"), abs_tol=1e-5) for p, (t, _) in zip(got, rows, strict=True))


def test_tokens_are_looked_up_over_shards(spark, tmp_path, monkeypatch):
    texts = ["the cat and the dog", "", None, "the the the", "a" * 3000]
    path = str(tmp_path / "w")
    wavelet.write_shards(frame(spark, texts), path, BYTE)
    ids = [pieces.library(BYTE)[0].encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    the = ids[0][3]
    flat = Counter(x for row in ids for x in row)
    assert {r["token"]: r["n"] for r in wavelet.token_totals(spark, path, [the, 0, 49999]).collect()} == {the: flat[the], 0: flat[0], 49999: flat[49999]}
    assert sorted(map(tuple, wavelet.occurrences(spark, path, the).collect())) == [(i, k) for i, row in enumerate(ids) for k, x in enumerate(row) if x == the]
    wanted = [(i, k) for i, row in enumerate(ids) for k in range(0, len(row), 3)] + [(0, 999), (77, 0)]
    got = wavelet.tokens_at(spark, path, spark.createDataFrame(wanted, "doc_id long, position long")).collect()
    assert sorted(map(tuple, got)) == [(i, k, ids[i][k]) for i, k in wanted[:-2]]


def test_ids_do_not_rest_on_a_hash(monkeypatch):
    """All hashes collide: blocks tell pre-tokens apart by their text, and a remembered one must meet the second hash."""
    texts = [["internationalisation extraordinarily überraschend überraschung"], ["extraordinarily sesquipedalian überraschend"]]
    want = [pieces.library(BYTE)[0].encode(t[0], add_special_tokens=False).ids for t in texts]
    real = pieces.Cut._hashes
    monkeypatch.setattr(pieces.Cut, "_hashes", lambda self, at, seeds=None: real(self, at, seeds) if seeds else np.full(len(at), 5, np.uint64))
    pieces.library_memory.cache_clear()
    assert [pieces.encode_block(BYTE, t)[0].tolist() for t in texts] == want
    pieces.library_memory.cache_clear()


def test_the_plan_has_a_bound():
    rng = random.Random(1)
    for capacity in (16, 1024):
        for _ in range(5):
            histogram = {n: rng.randrange(1, 10**7) for n in rng.sample(range(1, capacity + 1), capacity // 2)}
            assert len(packing.plan(histogram, capacity)) <= 3 * len(histogram) * (math.log2(capacity) + 2)


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, f"the quiet river number {i} runs under the stone {i * 7}", "en", -7.0, -9.0, "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_score double, `a.b` string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(*quality.labelled_sample(docs, labels))
    for out in (quality.accepted(docs, model), language.recognised(docs, language.fit(*language.labelled_sample(docs)), 0.3), order_minhash.one_of_each(docs), secret_scan.redact(docs)):
        assert out.columns == docs.columns and {(r["score"], r["lang_score"], r["a.b"]) for r in out.collect()} == {(-7.0, -9.0, "x")}
