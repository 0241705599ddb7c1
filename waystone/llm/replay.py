"""Byte-level BPE from a rank file by merge replay over a corpus block, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waystone.llm import pieces


class Replay:
    """The merges of a rank file. encode() takes the distinct pre-tokens of a block and applies each merge, lowest rank
    first, to all of them at once: an inverted index leads from a merge to the positions where its pair stands, and a merge
    updates only the pairs with its left and right neighbours."""

    def __init__(self, path: str):
        with open(pieces.resolved(path), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}

    def merge_of(self, a: int, b: int) -> int:
        """The rank of the token that a and b make, -1 if they make none."""
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return found

    def encode(self, words: list[str]) -> list[list[int]]:
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        token = [self.single[b] for w in data for b in w]
        n = len(token)
        word = np.repeat(np.arange(len(data)), [len(w) for w in data]).tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            if word[i] != word[i + 1]:
                after[i], before[i + 1] = -1, -1
        if n:
            after[-1] = -1
        index: dict[int, list[int]] = defaultdict(list)
        for i in range(n):
            if after[i] >= 0 and (r := self.merge_of(token[i], token[after[i]])) >= 0:
                index[r].append(i)
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            places = sorted(index.pop(rank, ()))
            wait: set[int] = set()  # words in which a lower merge has come up meanwhile
            for i in places:
                j = after[i]
                if token[i] < 0 or j < 0 or self.merge_of(token[i], token[j]) != rank:
                    continue
                if word[i] in wait:
                    index[rank].append(i)
                    continue
                token[i], token[j] = rank, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                for left, right in ((before[i], i), (i, k)):
                    if left >= 0 and right >= 0 and (r := self.merge_of(token[left], token[right])) >= 0:
                        if r not in index:
                            heappush(heap, r)
                        index[r].append(left)
                        if r < rank:
                            wait.add(word[i])
            if rank in index:
                heappush(heap, rank)
        out: list[list[int]] = [[] for _ in words]
        for i in range(n):
            if token[i] >= 0:
                out[word[i]].append(token[i])
        return out


@lru_cache(4)
def replay_of(path: str) -> tuple[Replay, pieces.Memory, np.ndarray, np.ndarray, np.ndarray]:
    """The merges, a worker's memory of pre-tokens, and the vocabulary's bytes: offset and size by id, then all bytes."""
    merges = Replay(path)
    size = max(merges.tokens) + 1
    sizes = np.array([len(merges.tokens.get(i, b"")) for i in range(size)], np.int64)
    flat = np.frombuffer(b"".join(merges.tokens.get(i, b"") for i in range(size)), np.uint8)
    return merges, pieces.Memory(merges.encode), np.cumsum(sizes) - sizes, sizes, flat


def encode_documents(docs: DataFrame, ranks: str, keep_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 and decoded_sha256 (and ids, little-endian unsigned 32-bit, on demand).

    The corpus is dealt out in blocks of whole documents; a block's pre-tokens are encoded once per distinct one by merge
    replay and put together for each document, then the ids are decoded again. Null texts count as empty, repeated rows are
    encoded each, columns other than doc_id and text are not read. There is no exchange, so hot keys and copies do not
    matter; a worker's memory of pre-tokens is bounded.
    """

    def encode(batches):
        _, memory, offset, size, flat = replay_of(ranks)
        for batch in batches:
            texts = pieces.text_list(batch.column("text"))
            counts, sha, back, kept = [], [], [], []
            for a, b in pieces.blocks(texts):
                cut = pieces.Cut(texts[a:b], "byte")
                ids, sizes = memory.expand(memory.look_up(cut))
                per = np.bincount(cut.owner, weights=sizes, minlength=b - a).astype(np.int64)
                ends = np.cumsum(per)
                ids = ids.astype("<u4")
                lengths = size[ids]
                byte_ends = np.cumsum(lengths)
                total = int(byte_ends[-1]) if len(byte_ends) else 0
                data = flat[np.repeat(offset[ids] - (byte_ends - lengths), lengths) + np.arange(total)]
                at = np.concatenate(([0], byte_ends))
                for e, k in zip(ends.tolist(), per.tolist(), strict=True):
                    counts.append(k)
                    sha.append(hashlib.sha256(ids[e - k : e]).hexdigest())
                    back.append(hashlib.sha256(data[at[e - k] : at[e]]).hexdigest())
                    if keep_ids:
                        kept.append(ids[e - k : e].tobytes())
            out = [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
