"""Personal data: base spans by the plain patterns, and what bootstrapped patterns find."""

import hashlib
import random
import re
import time

import pytest

from tests.llm.test_llm import by_id, docs_of
from waystone.llm import contextual

NAMES = ("email", "ip", "card", "phone", "context")


def checksum(digits):
    total = 0
    for i, x in enumerate(reversed(digits)):
        total += sum(divmod(2 * x, 10)) if i % 2 else x
    return total % 10 == 0


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        if 14 <= len(digits) <= 19 and checksum(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def shown(spans):
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_equal_plain_patterns():
    rng, found = random.Random(2), 0
    for _ in range(20_000):
        t = "".join(rng.choices(rng.choice(["ab@@..-é ", "12..300 ", "4242 -", "+1 ().-234", "a1@.+-% 0é٣"]), k=rng.randrange(60)))
        got = contextual.base_spans(t)
        assert got == plain_spans(t), t
        found += len(got)
    assert found > 1000


def test_very_long_texts_take_linear_time():
    began = time.time()
    for t in ("1" * 10**6, "1." * 500_000, "a@" * 500_000, "+1 " * 300_000, "a." * 500_000, "12-" * 300_000, "@a.b" * 200_000):
        contextual.candidates(t, contextual.base_spans(t))
    assert time.time() - began < 20


def corpus():
    """Seeds after "my contact is", unseen identifiers there and after "reach me at", whose own seeds are too few at first, and
    numbers that aren't personal."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = ["", None, "+", "Version 20240101 of it", "é my contact is 2024-11-17"]
    for i in range(30):
        texts.append(f"{word()} {word()} my contact is {word()}@mail{i}.example.com {word()}")
    for i in range(6):
        texts.append(f"{word()} {word()} my contact is ID-{7000 + i}-XY {word()}")
        texts.append(f"{word()} {word()} please reach me at ID-{7000 + i}-XY {word()}")
    for i in range(6):
        texts.append(f"{word()} {word()} please reach me at +1 (555) 0{i}1-23{i}4 {word()}")
    texts.append("then please reach me at KL-99881 soon")
    for i in range(40):
        texts.append(f"{word()} {word()} the build number {rng.randrange(10**6, 10**7)} {word()}")
        texts.append(f"{word()} {word()} the build number {word()}@build{i}.example.com {word()}" if i < 5 else word())
    return texts + [texts[40]] * 3


def plain_discovered(texts):
    """The graph of patterns and instances with plain dictionaries."""
    edges, seeds = {}, {}
    for t in texts:
        base = contextual.base_spans(t or "")
        places = [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in contextual.candidates(t or "", base)]
        for a, b, seed in places:
            x = contextual.instance(t[a:b])
            for p in contextual.patterns(t, a, b):
                edges.setdefault(p, set()).add(x)
                seeds[p, x] = seeds.get((p, x), False) or seed
    score = {}
    for _ in range(contextual.ROUNDS):
        sure = {}
        for p, xs in edges.items():
            known = sum(seeds[p, x] for x in xs)
            if known >= contextual.LEAST_SEEDS and known < len(xs):
                c = sum(1.0 if seeds[p, x] else score.get(x, 0.0) for x in xs) / (len(xs) + 0.5)
                if c >= contextual.CONFIDENT:
                    sure[p] = c
        after = {}
        for p, c in sure.items():
            for x in edges[p]:
                if not seeds[p, x]:
                    after[x] = after.get(x, 1.0) * (1 - c)
        score = {x: 1 - d for x, d in after.items()}
    return {x for x, s in score.items() if s >= contextual.CONFIDENT}


@pytest.fixture(scope="module")
def found(spark):
    return by_id(contextual.report(docs_of(spark, corpus()).repartition(4)))


def test_patterns_find_unseen_identifiers(found):
    texts = corpus()
    sure = plain_discovered(texts)
    assert len(found) == len(texts) and sure
    more = 0
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        extra = [(a, 4, b) for a, b in contextual.candidates(t or "", base) if contextual.instance(t[a:b]) in sure]
        assert found[i]["spans"] == shown(sorted(base + extra))
        assert found[i]["base_sha256"] == hashlib.sha256(shown(base).encode()).hexdigest()
        assert [found[i][f"n_{n}"] for n in NAMES[:4]] == [sum(k == j for _, k, _ in base) for j in range(4)]
        more += len(extra)
        if t and ("build number" in t or "Version" in t):
            assert "context" not in found[i]["spans"]
        if t and "ID-70" in t:
            assert "context" in found[i]["spans"]
    assert more >= 12
    last = texts.index("then please reach me at KL-99881 soon")
    assert found[last]["spans"].startswith("context:24:32")


def test_odd_rows(spark):
    assert contextual.report(docs_of(spark, ["a"]).limit(0)).count() == 0
    df = docs_of(spark, ["x 1.2.3.4", "x 1.2.3.4", None, ""], [5, 5, None, 6])
    got = sorted(map(str, ((r["doc_id"], r["n_ip"], r["spans"]) for r in contextual.report(df).collect())))
    assert got == sorted(map(str, [(5, 1, "ip:2:9"), (5, 1, "ip:2:9"), (None, 0, ""), (6, 0, "")]))
