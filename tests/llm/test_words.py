"""Words and sketches of near-duplicates against plain Python that shares no code with them."""

import random

from pyspark.sql import functions as F

from waystone.llm import language, order_minhash


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def likeness(a, b):
    """Jaccard of the five-word shingles of texts without repeated words, split by Python."""
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_words_are_split_at_white_space_only():
    texts = ["Due 2024-01-05, don't  wait.\n\tfinal.", "", "  ", "a-b", "x=1;y=2 http://a.b/c?d=e\u00a0z"]
    words = order_minhash.words_of(texts)
    assert [len(w) for w in words] == [len(t.split()) for t in texts]
    assert len(set(map(int, words[0]))) == 5


def test_one_word_of_dates_counts_as_one(spark):
    """A changed part of a date changes five shingles of 36, and a replaced date no more than a plain word."""
    rng = random.Random(4)
    day = lambda: f"{rng.randrange(1900, 2100)}-{rng.randrange(10, 99)}-{rng.randrange(100, 999)}"
    base = [day() for _ in range(40)]
    far = base[:20] + [base[20][:-1] + "x"] + base[21:]
    other = [day() for _ in range(60)]
    near = other[:30] + [day()] + other[31:]
    texts = [" ".join(w) for w in (base, far, other, near)]
    assert likeness(*texts[:2]) < 0.8 <= likeness(*texts[2:])
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_classes(frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


def test_short_near_texts_share_a_sketch():
    """Of each length up to 80 words, a text and a prefix of it of similarity 0.8 at least."""
    lost = []
    for n in range(5, 81):
        for k in range(40):
            base = [f"w{n}x{k}x{i}" for i in range(n)]
            other = base[: 4 + -(-4 * (n - 4) // 5)]
            a, b = (set(order_minhash.sketch(order_minhash.shingles(w))[0].tolist()) for w in order_minhash.words_of([" ".join(base), " ".join(other)]))
            lost += [(n, k)] * (not a & b)
    assert len(lost) <= 3  # 0.0004 of the pairs above FEW shingles, none below
    assert all(n > 36 for n, _ in lost)


def test_a_large_bucket_loses_no_link(spark, monkeypatch):
    """All texts meet in one bucket above BUCKET and in no other."""
    rng = random.Random(6)
    texts = []
    for g in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        texts += [" ".join(base), " ".join(base[:50] + [f"x{g}"] + base[51:])]
    monkeypatch.setattr(order_minhash, "BUCKET", 8)
    monkeypatch.setattr(order_minhash, "PIVOTS", 2)
    real = order_minhash.sketched
    monkeypatch.setattr(order_minhash, "sketched", lambda docs: real(docs).withColumn("keys", F.array(F.lit(7).cast("long"))))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_classes(frame(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(60)}


def test_rows_of_one_id_and_different_texts_all_stay(spark):
    """Repeated and null ids: each class keeps one row, and a copy goes even where its id is also a kept row's."""
    base = [f"w{i}" for i in range(100)]
    near = " ".join(base[:50] + ["x"] + base[51:])
    rows = [(1, " ".join(base)), (2, near), (2, "another text"), (2, "another text"), (3, "one"), (3, "two"), (None, "three"), (None, "four"), (None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, order_minhash.one_of_each(docs).collect()), key=str)
    assert got == sorted([rows[i] for i in (0, 2, 4, 5, 6, 7)], key=str)


def test_every_language_is_learned(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 70}") for i in range(2100)], "doc_id long, text string, lang string")
    assert set(language.labelled_sample(docs)[1]) == {f"l{i}" for i in range(70)}
    monkeypatch.setattr(language, "MAX_SAMPLE", 100)
    assert sorted(language.labelled_sample(docs)[1]) == sorted(f"l{i}" for i in range(70))
