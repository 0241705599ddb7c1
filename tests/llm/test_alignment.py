"""Alignment of two tokenizers against both libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import public_tokenizers as P
from tests.llm.test_llm import docs_of
from waystone.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def token_bytes(a, b):
    from tokenizers.pre_tokenizers import ByteLevel

    value = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]: c for c in range(128)}
    # the other bytes come after the printable ones of Latin-1, in order
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    value |= {chr(c): c for c in own} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in own)}
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    return lambda i: bytes(value[c] for c in a.id_to_token(i)), lambda i: piece(b.id_to_piece(i))


def plain(texts):
    """Per text n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 by sets of bytes and loops over all pairs."""
    a, b = libraries()
    of_a, of_b = token_bytes(a, b)
    rows, every = [], Counter()
    for t in texts:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        data = [list(map(f, x)) for f, x in zip((of_a, of_b), ids, strict=True)]
        if not t or any(b"".join(x) != (" " + t).encode() for x in data):
            rows.append(None)
            continue
        spans = []
        for part in data:
            at, out = 0, []
            for x in part:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(x, y) for x, (s, e) in zip(ids[0], spans[0], strict=True) for y, (u, v) in zip(ids[1], spans[1], strict=True) if s < v and u < e]
        groups, i, j = [], 0, 0
        for c in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            p, q = i, j
            while p < len(ids[0]) and spans[0][p][1] <= c:
                p += 1
            while q < len(ids[1]) and spans[1][q][1] <= c:
                q += 1
            groups.append(",".join(map(str, ids[0][i:p])) + "|" + ",".join(map(str, ids[1][j:q])))
            i, j = p, q
        every.update(links)
        rows.append((len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in every.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(every[x] == best[x[1]] for x in r[3]), sum(every[x] for x in r[3]), r[4]) for r in rows]


def some_texts():
    rng = random.Random(5)
    texts = ["", None, " ", "  ", "a ", "\n", "<|endoftext|> and <s> <unk> <0x41>", "a▁b", "日本語のテキスト、空白なし。" * 3, "x" * 90, "it's we'll  don't\n\n  go", "ﬁ Å é   z \r\n\tq\x00", "12 345 6789", "a b c", "a b c"]
    for _ in range(120):
        texts.append("".join(rng.choices("abe  \n\t's é日\xa0x12.,<|>", k=rng.randrange(80))))
    for _ in range(30):
        texts.append(" ".join("".join(rng.choices("thearionsé", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 40))))
    return texts


@pytest.mark.parametrize("chunk", [1 << 15, 11])
def test_alignment_equals_the_libraries(spark, monkeypatch, chunk):
    """Whole documents, and the same ones in chunks of a few characters put together by several rounds of the tree."""
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 300)
    texts = some_texts()
    df = docs_of(spark, texts).withColumnRenamed("part", "block").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(df, A, B).collect()}
    want = plain(texts)
    wrong = [(texts[i], got[i], w) for i, w in enumerate(want) if got[i] != w]
    assert len(got) == len(texts) and not wrong, wrong[:2]


def test_fragments_compose_in_any_order():
    pair, rng = alignment.pair_of(A, B), random.Random(1)
    for t in [x for x in some_texts() if x and "▁" not in x]:
        s = " " + t
        size = alignment.CHUNK
        try:
            alignment.CHUNK = 5
            a, b, byte = alignment.chunk_bounds(s)
        finally:
            alignment.CHUNK = size
        parts, done = [], []
        for k in range(len(a) - 1):
            (x,), (y,) = pair.encoded([s[a[k] : a[k + 1]]], [s[b[k] : b[k + 1]]])
            x, y = np.array(x, np.int64), np.array(y, np.int64)
            tokens = alignment.Tokens(x, byte[a[k]] + np.cumsum(pair.a_size[x]), y, byte[b[k]] + np.cumsum(pair.b_size[y]))
            out, more = alignment.fragment(tokens) if k else alignment.compose(alignment.START, alignment.Fragment(tokens, None))
            parts.append(alignment.unpacked(alignment.packed(out)))
            done += more
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k], more = alignment.compose(parts[k], parts.pop(k + 1))
            done += more
        assert not any(map(len, parts[0].prefix)) and not any(map(len, parts[0].suffix))
        whole = pair.encoded([s], [s])
        x, y = (np.array(w[0], np.int64) for w in whole)
        every = alignment.closed(alignment.Tokens(x, np.cumsum(pair.a_size[x]), y, np.cumsum(pair.b_size[y])), 0)
        assert ";".join(d.groups for d in sorted(done, key=lambda d: d.at)) == every.groups
        assert sum(d.n for d in done) == every.n and sorted(np.concatenate([d.links for d in done]).tolist()) == sorted(every.links.tolist())


def test_odd_rows(spark):
    assert alignment.align(docs_of(spark, ["a"]).limit(0), A, B).count() == 0
    df = docs_of(spark, ["same words here", "same words here", None, "", "a▁"], [5, 5, None, 6, 7])
    got = sorted((tuple(r) for r in alignment.align(df, A, B).collect()), key=str)
    want = [(i, *w) for i, w in zip([5, 5, None, 6, 7], plain(["same words here"] * 2 + [None, "", "a▁"]), strict=True)]
    assert got == sorted(want, key=str)


def test_numbers_in_planes():
    x = np.array([0, 1, 255, 256, 70_000, 2**31 - 1])
    assert alignment._numbers(alignment._planes(x)).tolist() == x.tolist() and alignment._numbers(b"").tolist() == []
