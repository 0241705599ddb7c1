"""Token ids in wavelet-matrix files: access, rank, select, counting and occurrence lookup on succinct bit planes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waystone.llm import pieces
from waystone.llm.shared import partitions

MAGIC = b"WVM2"
#: Tokens after which a shard ends; it holds whole documents.
SHARD_TOKENS = 1 << 18
#: Bits between two stored ranks.
RANK_EVERY = 512
END_ID = 0


class WaveletMatrix:
    """A sequence of ids as ceil(log2(distinct ids)) bit planes, most significant first, over the shard's own alphabet."""

    def __init__(self, alphabet: np.ndarray, n: int, planes: list[np.ndarray], ranks: list[np.ndarray]):
        """planes: packed bits, whole blocks of RANK_EVERY; ranks: per plane the ones before each block, and all ones."""
        self.alphabet, self.n, self.planes, self.ranks = alphabet, n, planes, ranks
        self.zeros = [n - int(r[-1]) for r in ranks]

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.bincount(ids, minlength=1) > 0 if len(ids) else np.zeros(1, bool)
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        code = np.zeros(len(seen), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        a, planes, ranks = code[ids], [], []
        blocks = -(-len(ids) // RANK_EVERY)
        for k in reversed(range(max(0, len(alphabet) - 1).bit_length())):
            bit = ((a >> k) & 1).astype(bool)
            plane = np.zeros(blocks * RANK_EVERY // 8, np.uint8)
            plane[: -(-len(ids) // 8)] = np.packbits(bit)
            planes.append(plane)
            ones = np.bitwise_count(plane.view(np.uint64)).reshape(blocks, -1).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32))))
            a = np.concatenate((a[~bit], a[bit]))
        return cls(alphabet, len(ids), planes, ranks)

    def decode(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        a = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(plane, count=self.n).view(bool)
            up = np.empty_like(a)
            up[~bit] = a[:zeros]
            up[bit] = a[zeros:] | a.dtype.type(1 << level)
            a = up
        return self.alphabet[a] if self.n else np.zeros(0, np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // RANK_EVERY
        whole, part = divmod(i, 8)
        plane = self.planes[level]
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(plane[block * RANK_EVERY // 8 : whole]).sum())
        return ones + (int(plane[whole] >> (8 - part)).bit_count() if part else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i >> 3] >> (7 - (i & 7))) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _range(self, token: int, i: int) -> tuple[int, int, int]:
        """The token's code, and where its occurrences before i start and end below the last plane."""
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return -1, 0, 0
        lo, hi = 0, i
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if code >> (len(self.planes) - 1 - level) & 1 else (lo - a, hi - b)
        return code, lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i ids."""
        _, lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0), -1 if there is none."""
        code, lo, hi = self._range(token, self.n)
        if k < 0 or lo + k >= hi:
            return -1
        at = lo + k
        for level in reversed(range(len(self.planes))):
            one = code >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] if one else at, one)
        return at

    def _select(self, level: int, k: int, one: int) -> int:
        """Position of the k-th bit that is one (or zero) in a plane."""
        return int(self._selects(level, np.array([k]), one)[0])

    def _selects(self, level: int, k: np.ndarray, one: int) -> np.ndarray:
        """Positions of several such bits: the directory leads to their blocks, and only those are looked at."""
        ranks = self.ranks[level].astype(np.int64)
        counts = ranks if one else np.arange(len(ranks)) * RANK_EVERY - ranks
        block = np.searchsorted(counts, k, "right") - 1
        touched, place = np.unique(block, return_inverse=True)
        bits = np.unpackbits(self.planes[level].reshape(-1, RANK_EVERY // 8)[touched], axis=1) == one
        row, column = np.nonzero(bits)
        return block * RANK_EVERY + column[np.searchsorted(row, np.arange(len(touched)))[place] + k - counts[block]]

    def occurrences(self, token: int) -> list[int]:
        return self.places(token).tolist()

    def places(self, token: int) -> np.ndarray:
        """Positions of all occurrences of token, ascending."""
        code, lo, hi = self._range(token, self.n)
        at = np.arange(lo, hi)
        for level in reversed(range(len(self.planes))):
            if len(at):
                one = code >> (len(self.planes) - 1 - level) & 1
                at = self._selects(level, at - self.zeros[level] if one else at, one)
        return at


def to_file(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's file: magic, counts, alphabet, document ids and sizes, then each bit plane after its rank directory."""
    matrix = WaveletMatrix.of(ids)
    planes = b"".join(r.astype("<u4").tobytes() + p.tobytes() for r, p in zip(matrix.ranks, matrix.planes, strict=True))
    docs = np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids)
    head = struct.pack("<QII", matrix.n, len(matrix.alphabet), len(doc_ids))
    return MAGIC + head + matrix.alphabet.astype("<u4").tobytes() + docs + np.asarray(sizes, "<u8").tobytes() + planes


def from_file(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their sizes and the matrix, which answers from the stored planes and directory: nothing is counted anew."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet-matrix shard")
    n, letters, docs = struct.unpack_from("<QII", data, 4)
    at = 4 + struct.calcsize("<QII")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    alphabet, ids, null, sizes = take("<u4", letters), take("<i8", docs), take("u1", docs), take("<u8", docs)
    planes, ranks, blocks = [], [], -(-n // RANK_EVERY)
    for _ in range(max(0, letters - 1).bit_length()):
        ranks.append(take("<u4", blocks + 1))
        planes.append(take("u1", blocks * RANK_EVERY // 8))
    return [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)], sizes.astype(np.int64), WaveletMatrix(alphabet, n, planes, ranks)


SHARDS = "shard int, n_docs long, n_tokens long, payload binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encodes the texts (null: empty) with the tokenizers file, ends each document with id 0 and writes shards to path.

    Files hold documents in ascending doc_id order (null first, equal ids by text hash): a range exchange deals the
    documents out, and each task streams its range into shards of SHARD_TOKENS ids, a long document being a shard of its
    own size. part numbers the ranges, shard the shards of a range. Columns other than doc_id and text are not read.
    """

    def encode(batches):
        names, sizes, ids, held, shard = [], [], [], 0, 0

        def flush():
            nonlocal names, sizes, ids, held, shard
            data = to_file(names, np.concatenate(sizes), np.concatenate(ids))
            out = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "payload": pa.array([data], pa.binary())})
            names, sizes, ids, held, shard = [], [], [], 0, shard + 1
            return out

        for batch in batches:
            texts, keys = pieces.text_list(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in pieces.blocks(texts):
                block, counts = pieces.encode_block(tokenizer, texts[a:b])
                ends = np.cumsum(counts)
                block = np.insert(block, ends, END_ID)
                counts = counts + 1
                names += keys[a:b]
                sizes.append(counts)
                ids.append(block)
                held += len(block)
                if held >= SHARD_TOKENS:
                    yield flush()
        if names:
            yield flush()

    ranged = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    ordered.mapInArrow(encode, SHARDS).select(F.spark_partition_id().alias("part"), "*").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards at path: doc_id, start, n_tokens, ids_crc32, part, shard.

    start counts the ids of all documents before it; it is summed in two steps, over the shards of a range and over ranges,
    so no task meets more rows than there are ranges or shards in one.
    """
    shards = spark.read.parquet(path)

    def decode(batches):
        for batch in batches:
            for part, shard, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "payload")), strict=True):
                names, sizes, matrix = from_file(payload)
                ids, ends = matrix.decode().astype("<u4"), np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                k = len(names)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * k, pa.int32()), "shard": pa.array([shard] * k, pa.int32()), "doc_id": pa.array(names, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "local": pa.array(ends - sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    rows = shards.select("part", "shard", "payload").mapInArrow(decode, "part int, shard int, doc_id long, n_tokens long, local long, ids_crc32 long")
    in_range = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by_shard = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(in_range), F.lit(0)).alias("in_range"))
    ranges = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = ranges.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(by_shard, ["part", "shard"]).join(before, "part").select("doc_id", (F.col("before") + F.col("in_range") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def token_totals(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of some tokens occurs in all shards, from the shards' rank directories."""

    def run(batches):
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                matrix = from_file(payload)[2]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], ["token", "n"])

    found = spark.read.parquet(path).select("payload").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    every = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token long")
    return every.join(F.broadcast(found), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))  # a row per token asked


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, position: every place of a token, counted from its document's first id, by select in each shard."""

    def run(batches):
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                names, sizes, matrix = from_file(payload)
                at, ends = matrix.places(token), np.cumsum(sizes)
                doc = np.searchsorted(ends, at, "right")
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in doc.tolist()], pa.int64()), pa.array(at - (ends - sizes)[doc], pa.int64())], ["doc_id", "position"])

    return spark.read.parquet(path).select("payload").mapInArrow(run, "doc_id long, position long")


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """token at each wanted (doc_id, position), by access in the one shard that holds it; places that no document of that id
    has are left out. The shards' heads tell where each document lies; a shard meets only its own places."""
    shards = spark.read.parquet(path)

    def heads(batches):
        for batch in batches:
            for part, shard, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "payload")), strict=True):
                names, sizes, _ = from_file(payload)
                columns = [pa.array([part] * len(names), pa.int32()), pa.array([shard] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(np.cumsum(sizes) - sizes, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "shard", "doc_id", "first", "n"])

    index = shards.select("part", "shard", "payload").mapInArrow(heads, "part int, shard int, doc_id long, first long, n long")
    placed = wanted.select("doc_id", "position").join(index, "doc_id").where("position >= 0 and position < n").withColumn("at", F.col("first") + F.col("position"))

    def look(places, shard):
        if not len(places) or not len(shard):
            return pa.table({c: pa.array([], pa.int64()) for c in ("doc_id", "position", "token")})
        matrix = from_file(shard.column("payload")[0].as_py())[2]
        tokens = [matrix.access(i) for i in places.column("at").to_pylist()]
        return pa.table({"doc_id": places.column("doc_id"), "position": places.column("position"), "token": pa.array(tokens, pa.int64())})

    both = placed.select("part", "shard", "doc_id", "position", "at").groupBy("part", "shard").cogroup(shards.select("part", "shard", "payload").groupBy("part", "shard"))
    return both.applyInArrow(look, "doc_id long, position long, token long")
