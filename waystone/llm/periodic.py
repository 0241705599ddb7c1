"""Periodic runs of words, by a dictionary of basic factors."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cmp_to_key

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from waystone.llm import pieces

#: A word is what these characters leave whole; a run is at least LEAST words and TURNS periods long.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST, TURNS = 6, 4
#: Characters of the documents whose factors are named together; a longer document is a block of its own.
BLOCK_CHARS = 400_000
#: White space of str.split() that isn't white space here.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def repeated(words: list[str], doc_id: int | None) -> list[str]:
    """words with the repetition that a document's id may ask for: from word a on every word is one of the first p after it."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def proposals(word: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (period, place) that propose runs in documents laid end to end. word: number of the word at each place, different in
    different documents; ends: the end of the document that each place is in.

    The dictionary names the factors of 1, 2, 4, .. words at each place where the factor occurs again in its document: the name
    of a factor of twice the length is that of its two halves. Successor occurrences of one factor of L words that are at
    most 2 L apart and equally far from a third one are an arithmetic progression, and its difference is a period. A run of
    period q has one at its start where L is the least power of two that isn't below q, as L + 2 q <= 4 q words fit into it.
    Progressions at neighbouring places are one proposal."""
    name, length = word.astype(np.int64), 1
    at = np.arange(len(word))
    out = []
    while len(at):
        order = np.argsort(name[at], kind="stable")
        place, names = at[order], name[at][order]
        again = names[1:] == names[:-1]
        gap = place[1:] - place[:-1]
        near = again & (gap <= 2 * length)
        three = np.flatnonzero(near[1:] & near[:-1] & (gap[1:] == gap[:-1]))
        if len(three):
            rows = np.stack((gap[three], place[three]), 1)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            first = np.ones(len(rows), bool)
            first[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1] + 1)
            out.append(rows[first])
        # factors that occur once are part of no repetition, and neither is what they are a half of
        often = np.zeros(len(order), bool)
        often[1:] |= again
        often[:-1] |= again
        number = np.cumsum(np.concatenate(([True], ~again))) - 1
        name = np.full(len(word), -1)
        name[place[often]] = number[often]
        at = np.sort(place[often])
        at = at[at + 2 * length <= ends[at]]
        at = at[name[at + length] >= 0]
        name[at] = name[at] * (len(word) + 1) + name[at + length]  # read below, at these places only
        length *= 2
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _equal_until(word: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words from places a and b on are equal, at most `most`; looks at twice as many each time."""
    done, step = 0, 32
    while done < most:
        n = min(step, most - done)
        other = np.flatnonzero(word[a + done : a + done + n] != word[b + done : b + done + n])
        if len(other):
            return done + int(other[0])
        done += n
        step *= 2
    return most


def runs_of(word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of documents laid end to end, by start and period. starts, ends: of the document of each place.

    Proposals are extended to both sides as far as words a period apart are equal; a proposal inside a run of its period that
    has been found is one with it."""
    found, reach = [], {}
    back = word[::-1]
    n = len(word)
    rows = proposals(word, ends)
    for period, place in rows[np.lexsort((rows[:, 1], rows[:, 0]))].tolist():
        if place < reach.get(period, 0):
            continue
        right = _equal_until(word, place, place + period, int(ends[place]) - place - period)
        left = _equal_until(back, n - place, n - place - period, place - int(starts[place]))
        start, length = place - left, left + right + period
        reach[period] = start + length - period
        if length >= max(LEAST, TURNS * period):
            found.append((start, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _compare(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """By length / period, exactly, the greatest first; then by start and period."""
    x, y = a[1] * b[2], b[1] * a[2]
    return y - x or a[0] - b[0] or a[2] - b[2]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def block_runs(lists: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, by start and period, places counted in its list."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(lists)), sizes)
    every = np.empty(int(bounds[-1]), object)
    every[:] = [w for words in lists for w in words]
    codes, uniques = pd.factorize(every)
    own = pd.factorize(owner * (len(uniques) + 1) + codes)[0]
    out: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    for start, length, period in runs_of(own, bounds[owner], bounds[owner + 1]):
        i = int(owner[start])
        out[i].append((start - int(bounds[i]), length, period))
    return out


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """words without what a run repeats after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def _grouped(sizes: list[int]):
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > BLOCK_CHARS:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def periodic_runs(docs: DataFrame, change=repeated) -> DataFrame:
    """Per row of docs: doc_id, n_runs, start, length, period and exponent_milli of the run of the greatest length / period,
    runs_sha256, collapsed_sha256, and runs (array of start, length, period, by start and period).

    change(words, doc_id) gives the words that are searched. A run is a longest stretch of at least TURNS times its smallest
    period and LEAST words. Null and empty texts have no words, no run, nulls for it and the digests of nothing; a null doc_id
    asks for no repetition; equal rows fare alike; a tie of exponents goes to the least start, then period; an empty table
    gives no rows; other columns aren't read. Documents stay where they are read, a block of them at a time, so no hot key
    or copy meets in one task; a very long document is a block of its own (about 100 bytes a word).
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            sizes = pa.compute.binary_length(texts).fill_null(0).to_pylist()
            for a, b in _grouped(sizes):
                lists = [change(words_of(t or ""), i) for t, i in zip(texts.slice(a, b - a).to_pylist(), ids[a:b], strict=True)]
                yield _report(ids[a:b], lists, batch.schema.field("doc_id").type)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>"


def _report(ids: list, lists: list[list[str]], kind: pa.DataType) -> pa.RecordBatch:
    rows = []
    for words, runs in zip(lists, block_runs(lists), strict=True):
        best = min(runs, key=cmp_to_key(_compare)) if runs else None
        milli = 1000 * best[1] // best[2] if best else None
        shown = _digest("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        named = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]
        rows.append((len(runs), *(best or (None,) * 3), milli, shown, _digest(" ".join(kept_words(words, runs))), named))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(run)]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
    names = [c.split(" ")[0] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs")]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], ["doc_id", *names])
