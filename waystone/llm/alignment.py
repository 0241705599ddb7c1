"""Alignment of two tokenizers' tokens by byte range: groups, links and how often the corpus links two ids.

Chunks of a text are fragments of an associative monoid: tokens up to the first place where both tokenizers end a token (open
prefix), closed groups, and tokens after the last such place (open suffix). Fragments are put together in any bracketing, so
very long documents are aligned by many tasks and joined by a tree of rounds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waystone.llm import pieces
from waystone.llm.shared import partitions, union_all, written

#: Characters of a chunk; a longer document is dealt out in chunks. Characters of the documents whose links are counted together.
CHUNK, BLOCK_CHARS = 1 << 15, 4_000_000
#: Fragments that one step of the tree puts together.
FAN = 8
#: Distinct units that a worker remembers; beyond it starts anew.
MEMORY = 300_000
#: Places where both tokenizers end a token: before a space that follows what isn't white space, and between a letter and a mark
#: that no piece of B holds after a letter (Pair sees to that).
LETTER, MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-/:-=?@\[-`{-~]"
BOTH_END = re.compile(rf"(?<=\S)(?= )|(?<={LETTER})(?={MARK})")
SPACE_MARK = "▁"
#: A pair of ids is one number: A's id times this, plus B's.
PAIR = 1 << 15


class Tokens(NamedTuple):
    """Tokens of both tokenizers in order: ids, and the byte of the text where each ends."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def upto(self, byte: int) -> Tokens:
        i, j = np.searchsorted(self.a_end, byte, "right"), np.searchsorted(self.b_end, byte, "right")
        return Tokens(self.a[:i], self.a_end[:i], self.b[:j], self.b_end[:j])

    def after(self, byte: int) -> Tokens:
        i, j = np.searchsorted(self.a_end, byte, "right"), np.searchsorted(self.b_end, byte, "right")
        return Tokens(self.a[i:], self.a_end[i:], self.b[j:], self.b_end[j:])

    def then(self, other: Tokens) -> Tokens:
        return Tokens(*map(np.concatenate, zip(self, other, strict=True)))

    def both_end(self) -> np.ndarray:
        return np.intersect1d(self.a_end, self.b_end, assume_unique=True)


NONE = Tokens(*[np.zeros(0, np.int64)] * 4)


#: Decimal ids.
NAMES = list(map(str, range(1 << 17)))


class Fragment(NamedTuple):
    """prefix: tokens up to the first place where both end; suffix: those after the last one, None where there is no such place."""

    prefix: Tokens
    suffix: Tokens | None


#: The start of a document: both tokenizers are at its first byte.
START = Fragment(NONE, NONE)


class Closed(NamedTuple):
    """Closed groups: the first byte, their text, how many they are and the pairs of ids of their links."""

    at: int
    groups: str
    n: int
    links: np.ndarray


def links_of(t: Tokens) -> np.ndarray:
    """The pair of each link of tokens that start and end together: between two ends that follow each other, whosever they are,
    there is one token of each, and no two such stretches have both tokens alike."""
    ends = np.union1d(t.a_end, t.b_end)
    return t.a[np.searchsorted(t.a_end, ends)] * PAIR + t.b[np.searchsorted(t.b_end, ends)]


def closed(t: Tokens, at: int) -> Closed:
    """The groups of tokens that start (at byte `at`) and end together."""
    ends = t.both_end()
    a, b = list(map(NAMES.__getitem__, t.a.tolist())), list(map(NAMES.__getitem__, t.b.tolist()))
    i, j = np.searchsorted(t.a_end, ends, "right").tolist(), np.searchsorted(t.b_end, ends, "right").tolist()
    groups = [",".join(a[p:q]) + "|" + ",".join(b[r:s]) for p, q, r, s in zip([0, *i], i, [0, *j], j, strict=False)]
    return Closed(at, ";".join(groups), len(groups), links_of(t))


def fragment(t: Tokens) -> tuple[Fragment, list[Closed]]:
    ends = t.both_end()
    if not len(ends):
        return Fragment(t, None), []
    first, last = int(ends[0]), int(ends[-1])
    inner = t.upto(last).after(first)
    return Fragment(t.upto(first), t.after(last)), [closed(inner, first)] if len(inner.a) else []


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, list[Closed]]:
    """The fragment of x's text and y's after it, and the groups that close where they meet. Associative; what closed inside
    x and y has been given out before."""
    middle = (x.prefix if x.suffix is None else x.suffix).then(y.prefix)
    if x.suffix is None:
        out, done = fragment(middle)
        if y.suffix is None or out.suffix is None:
            return out, done
        return Fragment(out.prefix, y.suffix), done  # the middle's last end is y's first, so nothing is left over there
    ends = middle.both_end()
    if not len(ends):
        return Fragment(x.prefix, middle), []
    first = x_end(x, middle)
    rest = middle.after(int(ends[-1])) if y.suffix is None else y.suffix
    return Fragment(x.prefix, rest), [closed(middle.upto(int(ends[-1])), first)]


def x_end(x: Fragment, middle: Tokens) -> int:
    """An order of places for what closes between two fragments: no later than its first end, after all that closed before."""
    return int(min(middle.a_end[0], middle.b_end[0])) - 1


def packed(x: Fragment) -> bytes:
    t = [*x.prefix, *(x.suffix or NONE)]
    head = np.array([x.suffix is not None, *map(len, t)], np.int64)
    return np.concatenate((head, *t)).astype("<i8").tobytes()


def unpacked(data: bytes) -> Fragment:
    x = np.frombuffer(data, "<i8")
    ends = 9 + np.cumsum(x[1:9])
    t = [x[e - n : e] for e, n in zip(ends.tolist(), x[1:9].tolist(), strict=True)]
    return Fragment(Tokens(*t[:4]), Tokens(*t[4:]) if x[0] else None)


class Pair:
    """The two tokenizers: ids and byte sizes, special strings being plain text."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        pieces.library(a_path, "byte")
        self.a = Tokenizer.from_file(pieces.resolved(a_path))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces.resolved(b_path))
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spoken = [p for i, p in enumerate(names) if not self.b.is_control(i) and not self.b.is_byte(i) and not self.b.is_unknown(i)]
        if {bytes([i]) for i in range(256)} - {bytes(byte_values()[c] for c in t) for t in self.a.get_vocab(with_added_tokens=False) if len(t) == 1}:
            raise ValueError(f"{a_path}: a byte has no token")
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}|{LETTER}{MARK}", p) for p in spoken) or len(names) > PAIR or self.a.get_vocab_size() * PAIR >= 1 << 31:
            raise ValueError(f"{b_path}: a piece goes on after a place in BOTH_END, or there are too many ids")
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(SPACE_MARK, " ").encode() for p in names]
        values = byte_values()
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b"" if t in special else bytes(values[c] for c in t) for t in (vocabulary.get(i, "") for i in range(max(vocabulary) + 1))]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.b_space, self.b_letter = self.b.piece_to_id(SPACE_MARK), self.b.encode("a")

    def encoded(self, a_texts: list[str], b_texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by A, and by B of texts that begin where both end: B puts a space before a text itself, so a text's own
        first one is left to it, and one without gets a letter to follow, whose ids are taken off again."""
        a = [e.ids for k in range(0, len(a_texts), 20_000) for e in self.a.encode_batch_fast(a_texts[k : k + 20_000], add_special_tokens=False)]
        b = self.b.encode([t[1:] if t[:1] == " " else "a" + t for t in b_texts], num_threads=1) if b_texts else []
        skip = len(self.b_letter)
        return a, [ids[skip:] if t[:1] != " " else ids if len(t) > 1 else [self.b_space] for t, ids in zip(b_texts, b, strict=True)]

    def same(self, ids: list[int], table: list[bytes], text: str) -> bool:
        return b"".join([table[i] for i in ids]) == text.encode("utf-8", "surrogatepass")


def byte_values() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable characters of Latin-1 stand for themselves, other bytes
    in order for those from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(2)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


class Units:
    """What each distinct unit (a stretch between two places where both end) closes: its fragment has no open side.

    counts: tokens of A, of B, groups and links of each unit; flat: the links' pairs one unit after another; ok: whether both
    tokenizers' bytes are the unit's."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts, self.ok = np.zeros((0, 4), np.int64), np.zeros(0, bool)
        self.first, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def look_up(self, units: list[str]) -> np.ndarray:
        if len(self.index) > MEMORY:
            self.clear()
        index = self.index
        new = [u for u in dict.fromkeys(units) if u not in index]
        for k in range(0, len(new), 50_000):
            self._add(new[k : k + 50_000])
        return np.fromiter(map(index.__getitem__, units), np.int64, len(units))

    def _add(self, new: list[str]) -> None:
        pair = self.pair
        a, b = pair.encoded(new, new)
        # A has a token for every byte and so gives back what it got; B drops nothing but may read a mark as a space
        ok = np.array([pair.same(y, pair.b_bytes, u) for u, y in zip(new, b, strict=True)], bool)
        a, b = ([x if good else [] for x, good in zip(ids, ok.tolist(), strict=True)] for ids in (a, b))
        flat = [np.fromiter((i for x in ids for i in x), np.int64, sum(map(len, ids))) for ids in (a, b)]
        t = Tokens(flat[0], np.cumsum(pair.a_size[flat[0]]), flat[1], np.cumsum(pair.b_size[flat[1]]))
        every = closed(t, 0)
        texts = every.groups.split(";") if every.n else []
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(new)) for ids in (a, b))
        # units laid end to end: groups and links of a unit are those whose end lies in it
        ends = np.concatenate(([0], t.a_end))[np.cumsum(n_a)]
        groups = np.searchsorted(t.both_end(), ends, "right")
        links = np.searchsorted(np.union1d(t.a_end, t.b_end), ends, "right")
        self.first = np.concatenate((self.first, len(self.flat) + np.concatenate(([0], links))[:-1]))
        self.flat = np.concatenate((self.flat, every.links.astype(np.int32)))
        self.counts = np.concatenate((self.counts, np.stack((n_a, n_b, np.diff(groups, prepend=0), np.diff(links, prepend=0)), 1)))
        self.ok = np.concatenate((self.ok, ok))
        self.groups += [";".join(texts[i:j]) for i, j in zip([0, *groups.tolist()], groups.tolist(), strict=False)]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))


@lru_cache(2)
def units_of(a_path: str, b_path: str) -> Units:
    return Units(pair_of(a_path, b_path))


PARTS = "block long, key long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, ids array<int>, counts array<int>"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers with their first bytes together, then their second ones: small numbers take little room on disk."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


class Counted:
    """Links of the parts of one block: part by part, numbered among the block's distinct pairs, and how often the block has each."""

    def __init__(self, links: np.ndarray, owner: np.ndarray, n: int):
        self.ids, number = np.unique(links, return_inverse=True)
        self.counts = np.bincount(number, minlength=len(self.ids))
        m = max(len(self.ids), 1)
        each, times = np.unique(owner * m + number, return_counts=True)
        at = np.searchsorted(each, np.arange(n + 1) * m)
        self.pairs, self.times = [], []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            self.pairs.append(_planes(np.diff(each[i:j] % m, prepend=0)))
            self.times.append(_planes(times[i:j]))


def _block_row(block: int, counted: Counted, schema: pa.Schema) -> pa.RecordBatch:
    held = {"block": [block], "ids": [counted.ids.astype(np.int32)], "counts": [counted.counts.astype(np.int32)]}
    return pa.RecordBatch.from_arrays([pa.array(held.get(f.name, [None]), f.type) for f in schema], schema=schema)


def _schema(kind: pa.DataType) -> pa.Schema:
    longs = [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    counted = [("pairs", pa.binary()), ("times", pa.binary()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
    return pa.schema([("block", pa.int64()), ("key", pa.int64()), ("doc_id", kind), *longs, ("groups_sha256", pa.string()), *counted])


def _places(tag: int) -> Iterator[int]:
    """Numbers that no other task of this stage, nor one of another tag, gives."""
    from pyspark import TaskContext

    first = (tag << 60) + (TaskContext.get().partitionId() << 36)
    return iter(range(first, first + (1 << 36)))


def _short_parts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of docs a part (key, doc_id, counts, groups_sha256, pairs and times of its links), and per block a row of its
    pairs (ids, counts)."""

    def run(batches):
        blocks, keys = _places(0), _places(0)
        units = units_of(a_path, b_path)
        schema = None
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            schema = schema or _schema(ids.type)
            sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
            for lo, hi in _grouped(sizes, BLOCK_CHARS):
                yield from _block_of(next(blocks), [next(keys) for _ in range(lo, hi)], ids.slice(lo, hi - lo), column.slice(lo, hi - lo).to_pylist(), units, schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", "text").mapInArrow(run, PARTS.format(kind=kind)), "parts")


def _grouped(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def _block_of(block: int, keys: list[int], ids: pa.Array, texts: list[str | None], units: Units, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    n = len(texts)
    cut = [BOTH_END.split(" " + t) if t else [] for t in texts]
    owner = np.repeat(np.arange(n), list(map(len, cut)))
    at = units.look_up([u for c in cut for u in c])
    bad = np.bincount(owner, weights=~units.ok[at], minlength=n) > 0
    if bad.any():
        at, owner = at[~bad[owner]], owner[~bad[owner]]
    sums = np.stack([np.bincount(owner, weights=c, minlength=n) for c in units.counts[at].T], 1).astype(np.int64) if n else np.zeros((0, 4), np.int64)
    size = units.counts[at, 3]
    ends = np.cumsum(size)
    links = units.flat[np.repeat(units.first[at] - (ends - size), size) + np.arange(int(size.sum()))]
    counted = Counted(links, np.repeat(owner, size), n)
    texts_at = list(map(units.groups.__getitem__, at.tolist()))
    bounds = np.searchsorted(owner, np.arange(n + 1)).tolist()
    sha = [hashlib.sha256(";".join(texts_at[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:], strict=False)]
    columns = {"block": [block] * n, "key": keys, "groups_sha256": sha, "pairs": counted.pairs, "times": counted.times}
    columns |= dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums.T, strict=True))
    yield pa.RecordBatch.from_arrays([ids if f.name == "doc_id" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
    yield _block_row(block, counted, schema)


def chunk_bounds(text: str) -> tuple[list[int], list[int], np.ndarray]:
    """Where chunks of A and of B begin (characters; the text's end last), and the byte of each character. Either one's are the
    first places at or after multiples of CHUNK where it alone surely ends a token, so the two differ and chunks stay open."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = pieces.class_table()[cp]
    n = len(cp)
    byte = np.concatenate(([0], np.cumsum(1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF))))
    before, here = kind[:-1], kind[1:]
    a = ((before == pieces.LETTER) | (before == pieces.NUMBER)) & (here != before) | (cp[1:] == 32) & (before != pieces.SPACE)
    b = (cp[1:] == 32) & (cp[:-1] != 32)
    marks = np.arange(CHUNK, n, CHUNK)
    out = []
    for safe in (a, b):
        places = np.append(np.flatnonzero(safe) + 1, n)
        out.append([0, *places[np.searchsorted(places, marks)].tolist(), n])
    return out[0], out[1], byte


def _chunked(docs: DataFrame) -> DataFrame:
    """Per row of docs its chunks: row, chunk, doc_id, and the first byte and the text of each tokenizer's part."""

    def run(batches):
        rows = _places(0)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text, row = " " + (text.as_py() or ""), next(rows)
                a, b, byte = chunk_bounds(text)
                n = len(a) - 1
                columns = [pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([doc_id] * n, batch.schema.field("doc_id").type)]
                for cuts in (a, b):
                    columns += [pa.array(byte[cuts[:-1]], pa.int64()), pa.array([text[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "chunk", "doc_id", "a_at", "a_text", "b_at", "b_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", "text").mapInArrow(run, f"row long, chunk long, doc_id {kind}, a_at long, a_text string, b_at long, b_text string"), "chunks")


STEP = "row long, chunk long, open binary, ok boolean, n_a long, n_b long, at long, groups string, n_groups long, links binary"
_STEP = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("open", pa.binary()), ("ok", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("at", pa.int64()), ("groups", pa.string()), ("n_groups", pa.int64()), ("links", pa.binary())])


def _step_rows(row: int, chunk: int, done: list[Closed], out: Fragment, ok=True, n_a=0, n_b=0) -> pa.RecordBatch:
    rows = [{"row": row, "chunk": chunk, "at": c.at, "groups": c.groups, "n_groups": c.n, "links": c.links.astype("<i4").tobytes()} for c in done]
    return pa.RecordBatch.from_pylist([*rows, {"row": row, "chunk": chunk, "open": packed(out), "ok": ok, "n_a": n_a, "n_b": n_b}], _STEP)


def _fragments(chunks: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per chunk its open fragment, and a row of the groups that close inside."""

    def run(batches):
        pair = pair_of(a_path, b_path)
        for batch in batches:
            for r in batch.to_pylist():
                (a,), (b,) = pair.encoded([r["a_text"]], [r["b_text"]])
                ok = pair.same(a, pair.a_bytes, r["a_text"]) and pair.same(b, pair.b_bytes, r["b_text"])
                x, y = np.array(a, np.int64), np.array(b, np.int64)
                t = Tokens(x, r["a_at"] + np.cumsum(pair.a_size[x]), y, r["b_at"] + np.cumsum(pair.b_size[y]))
                out, done = fragment(t) if r["chunk"] else compose(START, Fragment(t, None))
                yield _step_rows(r["row"], r["chunk"], done if ok else [], out if ok else START, ok, len(a), len(b))

    dealt = chunks.drop("doc_id").repartition(partitions(chunks.sparkSession), "row", "chunk")
    return written(dealt.mapInArrow(run, STEP), "fragments")


def _composed(step: DataFrame) -> DataFrame:
    """One round of the tree: FAN neighbouring fragments of a document become one."""

    def run(batches):
        held, acc, done = None, None, []
        for batch in batches:
            for row, group, data in zip(*(batch.column(c).to_pylist() for c in ("row", "next", "open")), strict=True):
                if held != (row, group):
                    if held:
                        yield _step_rows(*held, done, acc)
                    held, acc, done = (row, group), unpacked(data), []
                else:
                    acc, more = compose(acc, unpacked(data))
                    done += more
        if held:
            yield _step_rows(*held, done, acc)

    open_ = step.where("open is not null").select("row", "chunk", F.floor(F.col("chunk") / FAN).cast("long").alias("next"), "open")
    dealt = open_.repartition(partitions(step.sparkSession), "row", "next").sortWithinPartitions("row", "next", "chunk")
    return written(dealt.mapInArrow(run, STEP), "fragments")


def _group_digests(closed_rows: DataFrame) -> DataFrame:
    """(row, sha): the digest of each document's groups, hashed as they come by in order."""

    def run(batches):
        held, sha = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([sha.hexdigest()])], ["row", "sha"])
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("groups"), strict=True):
                if row != held:
                    if sha:
                        yield give()
                    held, sha = row, hashlib.sha256()
                else:
                    sha.update(b";")
                sha.update(text.as_py().encode())
        if sha:
            yield give()

    dealt = closed_rows.select("row", "at", "groups").repartition(partitions(closed_rows.sparkSession), "row").sortWithinPartitions("row", "at")
    return dealt.mapInArrow(run, "row long, sha string")


def _long_parts(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Of documents in chunks: rows like those of _short_parts for what closed in each chunk and round, and per document key,
    doc_id, counts and digest. Keys are below 0."""
    chunks = _chunked(docs)
    step = _fragments(chunks, a_path, b_path)
    steps, most = [step], chunks.agg(F.max("chunk")).first()[0] or 0
    while most:
        step, most = _composed(step), most // FAN
        steps.append(step)
    sums = steps[0].where("open is not null").groupBy("row").agg(F.min("ok").alias("ok"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    every = union_all([s.where("groups is not null") for s in steps])
    good = every.join(sums.where("ok").select("row"), "row", "left_semi")
    size = F.sum(F.octet_length("links") / 4).cast("long")
    groups = good.groupBy("row").agg(F.sum("n_groups").alias("n_groups"), size.alias("n_links"))
    names = chunks.where("chunk = 0").select("row", "doc_id")
    told = names.join(sums, "row").join(groups, "row", "left").join(_group_digests(good), "row", "left")
    count = lambda c: F.when(F.col("ok"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long").alias(c)
    info = told.select((-1 - F.col("row")).alias("key"), "doc_id", *map(count, ("n_a", "n_b", "n_groups", "n_links")), F.coalesce("sha", F.lit("")).alias("groups_sha256"))

    def run(batches):
        blocks, schema = _places(4), _schema(pa.int64())
        for batch in batches:
            data = batch.column("links").to_pylist()
            for lo, hi in _grouped(list(map(len, data)), BLOCK_CHARS):
                links = [np.frombuffer(x, "<i4").astype(np.int64) for x in data[lo:hi]]
                counted = Counted(np.concatenate(links), np.repeat(np.arange(hi - lo), list(map(len, links))), hi - lo)
                block = next(blocks)
                columns = {"block": [block] * (hi - lo), "key": batch.column("key").slice(lo, hi - lo), "pairs": counted.pairs, "times": counted.times}
                arrays = [columns[f.name] if f.name == "key" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(hi - lo, f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
                yield _block_row(block, counted, schema)

    parts = good.select((-1 - F.col("row")).alias("key"), "links").mapInArrow(run, PARTS.format(kind="long"))
    return written(parts.drop("doc_id"), "parts"), written(info, "told")


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, count, best) of every pair of ids that the corpus links; best: no other id of A is linked more often to its id of
    B. The greatest counts are one row per id of B, at most PAIR, and so may be broadcast."""
    flat = parts.where("ids is not null").select(F.explode(F.arrays_zip("ids", "counts")).alias("x")).select("x.ids", "x.counts")
    totals = flat.groupBy(F.col("ids").alias("pair")).agg(F.sum("counts").alias("count"))
    totals = written(totals, "pair-counts")
    most = totals.groupBy((F.col("pair") % PAIR).alias("b")).agg(F.max("count").alias("most"))
    met = totals.join(F.broadcast(most), F.col("pair") % PAIR == F.col("b"))
    return met.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _scored(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, n_best, count_sum) of each part: blocks look their pairs up by exchange, then meet their parts again."""
    asked = parts.where("ids is not null").select("block", F.posexplode("ids").alias("number", "pair"))
    met = asked.join(counts, "pair").select("block", "number", "count", "best")
    own = parts.where("ids is null").select(F.col("block").alias("own"), "key", "pairs", "times")

    def run(mine: pa.Table, found: pa.Table) -> pa.Table:
        number = found.column("number").to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], best[number] = found.column("count").to_numpy(), found.column("best").to_numpy()
        n_best, total = [], []
        for pairs, times in zip(mine.column("pairs").to_pylist(), mine.column("times").to_pylist(), strict=True):
            at, n = np.cumsum(_numbers(pairs)), _numbers(times)
            n_best.append(int((best[at] * n).sum()))
            total.append(int((count[at] * n).sum()))
        return pa.table([mine.column("key"), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], ["key", "n_best", "count_sum"])

    return own.groupBy("own").cogroup(met.groupBy("block")).applyInArrow(run, "key long, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    a_path: a byte-level tokenizers file, given space + text; b_path: a sentencepiece file, which puts the space there itself.
    Texts that are null, empty or not what either tokenizer's bytes say have no tokens: zeros and ''. Documents of up to CHUNK
    characters are aligned where they are read, each distinct unit of a worker's once; longer ones are dealt out in chunks
    whose fragments a tree of rounds composes. Links are numbered and counted by blocks of documents, summed over the corpus by
    exchange, and looked up once per pair and block. Equal rows and ids are told apart by a number of the row; an empty table
    gives no rows; other columns aren't read.
    """
    length = F.length("text")
    short = _short_parts(docs.where(F.coalesce(length <= CHUNK, F.lit(True))), a_path, b_path)
    far, told = _long_parts(docs.where(length > CHUNK), a_path, b_path)
    info = short.where("key is not null").select(told.columns).unionByName(told)
    parts = union_all([x.select("block", "key", "pairs", "times", "ids", "counts") for x in (short, far)])
    counts = written(pair_counts(parts), "pair-best")
    sums = _scored(parts, counts).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return info.join(sums, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
