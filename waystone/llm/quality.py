"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waystone.llm import pieces
from waystone.llm.shared import appended

#: Character-pair terms (hashed), latent dimensions, neighbours and the power of the similarity that weights a vote.
TERMS, DIMENSIONS, NEIGHBOURS, POWER = 4096, 64, 31, 8
#: Labelled documents learned from, at most: the bound of what is collected and broadcast.
MAX_LABELLED = 4000
#: A repeated word (equal to the one before it) is a term of its own, with this weight.
REPEAT_WEIGHT = 8.0
ACCEPT = 0.3
#: Documents of a block of cosine products.
ROWS = 256


def term_counts(texts: list[str]) -> np.ndarray:
    """Per text the counts of its character pairs (hashed to TERMS), and of words that repeat the word before."""
    cut = pieces.Cut([t + "\n" for t in texts], "space")
    cp = np.frombuffer(cut.joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    term = ((cp[:-1] * 31 + cp[1:]) * 2654435761 >> 7) % TERMS
    inside = owner[:-1] == owner[1:]
    out = np.zeros((len(texts), TERMS + 1), np.float32)
    out[:, :TERMS] = np.bincount(owner[:-1][inside] * TERMS + term[inside], minlength=len(texts) * TERMS).reshape(len(texts), TERMS)
    again = (cut.hash[1:] == cut.hash[:-1]) & (cut.owner[1:] == cut.owner[:-1])
    out[:, TERMS] = np.bincount(cut.owner[1:][again], minlength=len(texts))
    return out


@dataclass
class Model:
    idf: np.ndarray
    latent: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, of length 1
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.idf) @ self.latent)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, by similarity to the POWER; without neighbours the labels' mean."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
        weight = np.take_along_axis(near, best, 1).clip(0).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        return np.where(total > 1e-12, (weight * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-12), self.labels.mean()).clip(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = np.maximum(counts[:, :TERMS].sum(axis=1, keepdims=True), 1)
    return unit(np.log1p(counts / total * 1000) * idf)


def counted(texts: list[str]) -> np.ndarray:
    """term_counts of any number of texts, in blocks."""
    blocks = [term_counts(texts[a:b]) for x, y in pieces.blocks(texts) for a, b in ((i, min(y, i + ROWS)) for i in range(x, y, ROWS))]
    return np.concatenate(blocks) if blocks else np.zeros((0, TERMS + 1), np.float32)


def fit(counts: np.ndarray, labels: list[int], seed: int = 0) -> Model:
    """Latent semantic analysis of the labelled texts' term counts by randomised subspace iteration; equal inputs give equal
    models."""
    idf = (np.log((len(counts) + 1) / ((counts > 0).sum(axis=0) + 1)) + 0.2).astype(np.float32)
    idf[TERMS] *= REPEAT_WEIGHT
    if not len(counts):
        return Model(idf, np.zeros((TERMS + 1, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = weighted(counts, idf)
    size = min(DIMENSIONS + 16, len(x), TERMS + 1)
    y = x @ np.random.default_rng(seed).standard_normal((TERMS + 1, size)).astype(np.float32)
    for _ in range(3):
        y = np.linalg.qr(x @ (x.T @ y))[0]
    latent = np.linalg.svd(y.T @ x, full_matrices=False)[2][:DIMENSIONS].T.astype(np.float32)
    return Model(idf, latent, unit(x @ latent).astype(np.float32), np.array(labels, np.float64))


def remainder(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, list[int]]:
    """Term counts of at most `limit` labelled texts outside the held-out part, least id hash first, and the rows' quality.

    Ids are chosen first, so that only the chosen rows' texts travel, and workers count their terms: the driver gets at most
    6 bytes a term of each, never a text. Labels other than 0 and 1 are left out; of several labels or rows of one id the
    least is taken.
    """
    good = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    ids = docs.select("doc_id").join(good, "doc_id", "left_semi")
    ids = ids.where(remainder(F.col("doc_id"), 5) != 0).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = F.broadcast(ids.join(good, "doc_id"))  # at most limit ids
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("_quality").alias("_quality"))

    def count(batches):
        for batch in batches:
            terms, numbers = [], []
            for row in counted(batch.column("text").to_pylist()):
                there = np.flatnonzero(row)
                terms.append(there.astype("<u2").tobytes())
                numbers.append(row[there].astype("<f4").tobytes())
            columns = [batch.column("doc_id"), batch.column("_quality"), pa.array(terms, pa.binary()), pa.array(numbers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_quality", "terms", "numbers"])

    kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in ("doc_id", "_quality")]
    rows = texts.mapInArrow(count, ", ".join([*kinds, "terms binary", "numbers binary"])).collect()  # at most limit rows
    rows.sort(key=lambda r: r["doc_id"])
    out = np.zeros((len(rows), TERMS + 1), np.float32)
    for i, r in enumerate(rows):
        out[i, np.frombuffer(r["terms"], "<u2")] = np.frombuffer(r["numbers"], "<f4")
    return out, [int(r["_quality"]) for r in rows]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns by position (c0, c1, ..) with score (0 to 1) after them, whatever docs' own are called.

    Null and empty texts are scored too; equal texts get scores that agree to the rounding of single precision; a very long
    text is a block of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vote(column):
        out = np.zeros(len(column))
        for x, y, texts in pieces.text_blocks(column):
            for a in range(x, y, ROWS):
                b = min(y, a + ROWS)
                out[a:b] = shared.value.score(term_counts(texts[a - x : b - x]))
        return (pa.array(out),)

    return appended(docs, vote, score="double")


def accepted(docs: DataFrame, model: Model, least: float = ACCEPT) -> DataFrame:
    """The rows of docs, as they are, whose score is at least `least`."""
    return scored(docs, model).where(F.col("score") >= least).drop("score").toDF(*docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if score >= 0.3). Labels, lang, source and doc_id don't enter a score.

    No labelled row: every score is 0.5. Empty texts have no terms and get the labelled vectors' mean label. The model is
    broadcast (at most MAX_LABELLED vectors), and every document is scored where it is read: no exchange, no hot key.
    """
    model = fit(*labelled_sample(docs, labels))
    out = scored(docs.select("doc_id", "text"), model).withColumnRenamed("c0", "doc_id")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
