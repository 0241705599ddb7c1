"""Pre-tokens of whole text blocks, found and told apart with numpy, and a per-worker memory of what each one encodes to.

A block is a bounded number of characters of whole documents. Its pre-tokens are cut by character class, exactly as the
tokenizers' own patterns cut them; equal ones get one key, so that anything costly is done once per distinct pre-token. Where
a key is a hash, the pre-tokens of a block are compared themselves and those of earlier blocks by a second, secret hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Characters of a block; a longer document is a block of its own.
BLOCK_CHARS = 500_000
#: Distinct pre-tokens that a worker remembers; beyond it starts anew.
MEMORY = 900_000
#: Pre-tokens of more characters than this are told apart by their text, not by hash.
LONG = 64


@lru_cache(1)
def class_table() -> np.ndarray:
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        out[[m.start() for m in regex.finditer(pattern, every)]] = kind
    return out


def _seeds(seed: int | None) -> tuple[np.uint64, np.ndarray, np.uint64]:
    """An odd base, 64-bit values for characters (folded to 64 k), and a last multiplier."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.uint64(int(rng.integers(2**62)) | 1), values, np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def powers() -> tuple[np.uint64, np.ndarray, np.uint64]:
    """Seeds that are alike in every process."""
    return _seeds(7)


@lru_cache(1)
def own_seeds() -> tuple[np.uint64, np.ndarray, np.uint64]:
    """Seeds from the system's entropy: nobody can build texts whose hashes by them agree."""
    return _seeds(None)


class Cut:
    """Pre-tokens of a list of texts: starts, ends (code points of joined), owner (index of the text), hash and exact."""

    def __init__(self, texts: list[str], style: str):
        self.joined = "".join(texts)
        cp = self.cp = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.firsts = np.concatenate(([0], np.cumsum(lengths)))
        n = len(cp)
        g = class_table()[cp]
        if style == "white":
            g = np.where(g == SPACE, g, OTHER)  # words are what white space leaves whole
        doc = np.zeros(n + 1, bool)
        doc[self.firsts] = True
        cut = np.ones(n + 1, bool)
        cut[1:n] = g[1:] != g[:-1]
        cut |= doc
        if style == "word":
            cut[:n] |= g == NUMBER  # each number stands alone
        elif style == "byte":
            at = np.flatnonzero(cut[1:n]) + 1
            at = at[(g[at] != SPACE) & (g[at - 1] == SPACE) & ~doc[at]]
            cut[at - 1] = True
            cut[at[cp[at - 1] == 32]] = False
        if style not in ("space", "white"):
            self._contractions(cp, g, cut, doc, n)
        bounds = np.flatnonzero(cut)
        self.starts, self.ends = bounds[:-1], bounds[1:]
        if style != "byte":
            keep = g[self.starts] != SPACE
            self.starts, self.ends = self.starts[keep], self.ends[keep]
        self.owner = np.searchsorted(self.firsts, self.starts, "right") - 1 if len(texts) else np.zeros(0, np.int64)
        self.sizes = self.ends - self.starts
        self.hash, self.exact = self._keys()

    @staticmethod
    def _contractions(cp, g, cut, doc, n) -> None:
        at = np.flatnonzero(cut[:n] & (cp == 39))
        at = at[at + 1 < n]
        at = at[(g[at + 1] == LETTER) & ~doc[at + 1]]
        one = at[np.isin(cp[at + 1], [ord(c) for c in "stmd"])]
        two = at[at + 2 < n]
        two = two[~doc[two + 2]]
        pair = cp[two + 1].astype(np.int64) * 0x110000 + cp[two + 2]
        two = two[np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])]
        for found, size in ((one, 2), (two, 3)):
            cut[found + 1] = False
            cut[found + size] = True

    def _keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit key of each pre-token, and whether it is exact: up to 7 characters below 256 are packed with their number
        and so told apart from all others; longer or wider ones have a hash, which same() confirms."""
        wide = np.cumsum(self.cp > 255) if len(self.cp) and self.cp.max() > 255 else np.zeros(len(self.cp), np.int64)
        wide = np.concatenate(([0], wide))
        exact = (self.sizes <= 7) & (wide[self.ends] == wide[self.starts])
        out = np.zeros(len(self.starts), np.uint64)
        at = np.flatnonzero(exact)
        narrow = np.concatenate((self.cp.astype(np.uint8), np.zeros(8, np.uint8)))
        eight = np.lib.stride_tricks.as_strided(narrow[:8].view(np.uint64), (len(self.cp) + 1,), (1,))  # 8 characters from each place on
        size = self.sizes[at].astype(np.uint64)
        out[at] = (eight[self.starts[at]] & ((np.uint64(1) << (size * np.uint64(8))) - np.uint64(1))) | (size << np.uint64(56))
        at = np.flatnonzero(~exact)
        out[at] = (self._hashes(at) >> np.uint64(8)) | np.uint64(0xFF << 56)
        return out, exact

    def _hashes(self, at: np.ndarray, seeds: tuple | None = None) -> np.ndarray:
        base, values, mix = seeds or powers()
        sizes, starts = self.sizes[at], self.starts[at]
        out, live = np.zeros(len(at), np.uint64), np.arange(len(at))
        for k in range(LONG):
            live = live[sizes[live] > k] if k else live
            if not len(live):
                break
            c = self.cp[starts[live] + k]
            out[live] = out[live] * base + values[c & 0xFFFF] + c
        out ^= out >> np.uint64(29)
        out *= mix
        out ^= out >> np.uint64(32)
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = _digest(self.word(at[i]), int(base))
        return out

    def second(self, at: np.ndarray) -> np.ndarray:
        """Another 64-bit hash of pre-tokens, of seeds that no other process has; 0 where the key is exact."""
        out = np.zeros(len(at), np.uint64)
        hashed = np.flatnonzero(~self.exact[at])
        out[hashed] = self._hashes(at[hashed], own_seeds())
        return out

    def same(self, i: np.ndarray, j: np.ndarray) -> bool:
        """Whether pre-tokens i equal pre-tokens j, all of them, character by character."""
        apart = i != j
        i, j = i[apart], j[apart]
        n = self.sizes[i]
        if (n != self.sizes[j]).any():
            return False
        for x, y in zip(i[n > LONG].tolist(), j[n > LONG].tolist(), strict=True):
            if self.word(x) != self.word(y):
                return False
        short = n <= LONG
        a, b, n = self.starts[i[short]], self.starts[j[short]], n[short]
        for k in range(LONG):
            live = n > k
            if not live.any():
                return True
            a, b, n = a[live], b[live], n[live]
            if (self.cp[a + k] != self.cp[b + k]).any():
                return False
        return True

    def word(self, i: int) -> str:
        return self.joined[self.starts[i] : self.ends[i]]


def _digest(word: str, key: int) -> np.uint64:
    import hashlib

    found = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8, key=key.to_bytes(8, "little")).digest()
    return np.uint64(int.from_bytes(found, "little"))


def _firsts(codes: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first


class Memory:
    """What each distinct pre-token encodes to: filled by encode(list of words) -> list of id lists. Pre-tokens are remembered
    by their key and, where that is a hash, by a second hash of secret seeds, which every hit must meet as well."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.second = np.zeros(0, np.uint64)
        self.sizes, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.offsets = np.zeros(0, np.int64)

    def look_up(self, cut: Cut) -> np.ndarray:
        """The memory's index of each pre-token of cut."""
        codes, uniques = pd.factorize(cut.hash)
        first, hashed = _firsts(codes, len(uniques)), np.flatnonzero(~cut.exact)
        if not cut.same(hashed, first[codes[hashed]]):  # two pre-tokens of this block share a hash: told apart by their text
            codes, uniques = pd.factorize(np.array([cut.word(i) for i in range(len(cut.starts))], object))
            first = _firsts(codes, len(uniques))
        keys = cut.hash[first].tolist()
        if len(self.index) + len(keys) > MEMORY and len(self.index) > len(keys) or len(self.ids) > 8 * MEMORY:
            self._clear()
        index, second = self.index, cut.second(first)
        found = np.array([index.get(k, -1) for k in keys], np.int64)
        if len(self.second):
            found[(found >= 0) & (self.second[found] != second)] = -1
        new = np.flatnonzero(found < 0)
        if len(new):
            out = self.encode([cut.word(i) for i in first[new].tolist()])
            at = len(self.sizes)
            sizes = np.fromiter(map(len, out), np.int32, len(out))
            flat = np.fromiter((x for ids in out for x in ids), np.int32, int(sizes.sum()))
            self.offsets = np.concatenate((self.offsets, len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes))
            self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, flat))
            self.second = np.concatenate((self.second, second[new]))
            found[new] = np.arange(at, at + len(new))
            index.update(zip([keys[j] for j in new.tolist()], found[new].tolist(), strict=True))
        return found[codes] if len(codes) else np.zeros(0, np.int64)

    def sizes_of(self, cut: Cut) -> np.ndarray:
        """How many tokens each pre-token of cut has."""
        at = self.look_up(cut)
        return self.sizes[at]

    def expand(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens in order, and how many each has."""
        sizes = self.sizes[at].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.offsets[at] - (ends - sizes), sizes) + np.arange(total)], sizes


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most BLOCK_CHARS, or of one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > BLOCK_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def text_blocks(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of a column of texts of at most `most` (BLOCK_CHARS) bytes, or of one text, with their texts (null: empty). Only one
    block's texts are Python strings at a time, however many the batch has."""
    sizes, most = pa.compute.binary_length(column).fill_null(0).to_pylist(), most or BLOCK_CHARS
    at, size = 0, 0
    for i, n in enumerate(sizes):
        if i > at and size + n > most:
            yield at, i, text_list(column.slice(at, i - at))
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes), text_list(column.slice(at, len(sizes) - at))


def resolved(name: str) -> str:
    """The path of a vocabulary file: a path as it is, a bare name by the place of the public files on this machine."""
    import os

    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: The blocks of a tokenizers file that Cut's styles "byte" and "word" state.
BYTE_BLOCKS = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_BLOCKS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


@lru_cache(8)
def library(path: str, blocks: str | None = None):
    """The tokenizers file at path and its special strings. Raises where the file cuts or normalises texts otherwise than
    Cut's style `blocks` (or any of both) does, or has a dropout, or special strings that take white space or need whole
    words."""
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(resolved(path), encoding="utf-8") as f:
        text = f.read()
    stated = json.loads(text)
    styles = {"byte": BYTE_BLOCKS, "word": WORD_BLOCKS}
    if not any(all(stated.get(k) == v for k, v in styles[style].items()) for style in ([blocks] if blocks else styles)):
        raise ValueError(f"{path}: its normaliser or pre-tokenizer isn't the one that is stated here")
    added = stated.get("added_tokens", [])
    if stated["model"].get("dropout") or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["special"] for t in added):
        raise ValueError(f"{path}: dropout or added tokens of another kind")
    return Tokenizer.from_str(text), {t["content"]: t["id"] for t in added}


@lru_cache(8)
def library_memory(path: str, blocks: str = "byte") -> Memory:
    tokenizer, _ = library(path, blocks)

    def encode(words: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(words), 20_000) for e in tokenizer.encode_batch_fast(words[k : k + 20_000], add_special_tokens=False)]

    return Memory(encode)


def forget() -> None:
    """Frees what this worker remembers of pre-tokens, for tasks that have no use for it: workers serve one stage after another.
    What is free goes back to the system too, where the C library can do that."""
    import ctypes

    library_memory.cache_clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def split_special(texts: list[str], special: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at special strings: the parts between, the text each is of, and the special id after it (-1: none)."""
    if not any(s in t for s in special for t in texts):
        return texts, np.arange(len(texts)), np.full(len(texts), -1)
    import re

    pattern = re.compile("|".join(map(re.escape, special)))
    parts, owner, after = [], [], []
    for i, t in enumerate(texts):
        end = 0
        for m in pattern.finditer(t):
            parts.append(t[end : m.start()])
            owner.append(i)
            after.append(special[m[0]])
            end = m.end()
        parts.append(t[end:])
        owner.append(i)
        after.append(-1)
    return parts, np.array(owner), np.array(after)


def encode_block(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids (uint32) of all texts one after another by the byte-level tokenizer file at path, and how many each text has."""
    _, special = library(path, "byte")
    memory = library_memory(path, "byte")
    parts, owner, after = split_special(texts, special)
    cut = Cut(parts, "byte")
    ids, sizes = memory.expand(memory.look_up(cut))
    per_part = np.bincount(cut.owner, weights=sizes, minlength=len(parts)).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
    if (after >= 0).any():
        ends = np.cumsum(per_part)
        at = np.flatnonzero(after >= 0)
        ids = np.insert(ids, ends[at], after[at])
        per_part[at] += 1
    return ids.astype(np.uint32), np.bincount(owner, weights=per_part, minlength=len(texts)).astype(np.int64)


def text_list(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]

