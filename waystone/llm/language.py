"""Language by a byte convolutional network: multi-width filters, max pooling and softmax, trained and applied with numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waystone.llm import pieces
from waystone.llm.quality import remainder
from waystone.llm.shared import appended

#: Bytes of a window, filter widths and filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: What is learned from, at most: documents of a language, of all (but one of each language), windows of a document.
MAX_DOCUMENTS, MAX_SAMPLE, MAX_WINDOWS = 400, 25_600, 6
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Windows computed at a time.
CHUNK = 256
UNKNOWN = "und"


def windows(text: str) -> np.ndarray:
    """The UTF-8 bytes of a whole text in windows, the last one padded with zero bytes."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros((-(-len(data) // WINDOW) or 1, WINDOW), np.uint8)
    out.reshape(-1)[: len(data)] = data
    return out


@dataclass
class Model:
    languages: list[str]
    filters: list[np.ndarray]  # per width: width x 256 bytes x FILTERS
    bias: np.ndarray  # of the filters
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray

    def __post_init__(self):
        self._first = self._second = None

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Max-pooled filter responses of windows: pairs of bytes are looked up in two tables, as filters are linear."""
        if self._first is None:
            one, two = [], []
            for f in self.filters:
                one.append((f[0][:, None, :] + f[1][None, :, :]).reshape(65536, FILTERS))
                if len(f) > 2:
                    two.append((f[2][:, None, :] + (f[3][None, :, :] if len(f) > 3 else 0 * f[0][None, :, :])).reshape(65536, FILTERS))
            self._first, self._second = np.ascontiguousarray(np.concatenate(one, 1)), np.ascontiguousarray(np.concatenate(two, 1))
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        response = self._first[pair[:, :-2]]
        response[:, :, FILTERS:] += self._second[pair[:, 2:]]
        return np.maximum(response.max(axis=1) + self.bias, 0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the mean log probability of all its windows, weighted by their bytes."""
        each = [windows(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in each])
        x = np.concatenate(each) if each else np.zeros((0, WINDOW), np.uint8)
        weight = (x > 0).sum(axis=1)
        sums = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(x), CHUNK):
            np.add.at(sums, owner[a : a + CHUNK], self.log_probabilities(x[a : a + CHUNK]) * weight[a : a + CHUNK, None])
        mean = sums / np.maximum(np.bincount(owner, weights=weight, minlength=len(texts)), 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[i] for i in best.tolist()], p[np.arange(len(texts)), best]


def some_windows(text: str) -> np.ndarray | None:
    """Up to MAX_WINDOWS windows of a text, chosen by the text alone; none of a text without a letter."""
    if not any(map(str.isalpha, text)):
        return None
    w = windows(text)
    return w[np.sort(np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace"))).permutation(len(w))[:MAX_WINDOWS])]


def fit(sample: list[np.ndarray], languages: list[str], seed: int = 0) -> Model | None:
    """Trains by Adam on the windows of some texts and their languages; None if there are none."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    if not sample:
        return None
    place = {name: i for i, name in enumerate(names)}
    x, y = np.concatenate(sample), np.repeat([place[name] for name in languages], [len(w) for w in sample])
    n, total = len(names), FILTERS * len(WIDTHS)
    filters = [rng.standard_normal((w, 256, FILTERS)).astype(np.float32) * 0.1 for w in WIDTHS]
    bias, out, out_bias = np.zeros(total, np.float32), (rng.standard_normal((total, n)) * 0.1).astype(np.float32), np.zeros(n, np.float32)
    weights = [*filters, bias, out, out_bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    class_weight = (len(y) / (n * np.maximum(np.bincount(y, minlength=n), 1)))[y].astype(np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            at = order[a : a + BATCH]
            bx, by, size = x[at], y[at], WINDOW - max(WIDTHS) + 1
            peaks, places = [], []
            for f in filters:
                response = sum(f[o][bx[:, o : o + size]] for o in range(len(f)))
                place = response.argmax(axis=1)
                places.append(place)
                peaks.append(np.take_along_axis(response, place[:, None, :], 1)[:, 0])
            z = np.concatenate(peaks, 1) + bias
            hidden = np.maximum(z, 0)
            logits = hidden @ out + out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(by)), by] -= 1
            p *= class_weight[at][:, None] / len(by)
            back = (p @ out.T) * (z > 0)
            grads = []
            for i, f in enumerate(filters):
                g = np.zeros_like(f)
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for o in range(len(f)):
                    np.add.at(g[o], (bx[np.arange(len(at))[:, None], places[i] + o], np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for w, g, (m, v) in zip(weights, grads, moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(names, filters, bias, out, out_bias)


def labelled_sample(docs: DataFrame) -> tuple[list[np.ndarray], list[str]]:
    """Windows and languages of texts to learn from: of every language MAX_DOCUMENTS by id hash, or fewer (one at least) where
    many languages share MAX_SAMPLE.

    Ids are counted per language first. A hash below twice the wanted share lets about twice the wanted number of a language
    through, however many it has, and only those are ranked: no task meets a language's rows whole. Of the chosen texts the
    workers cut the windows, so that the driver gets MAX_WINDOWS * WINDOW bytes of each at most, never a text.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg(F.min("lang").alias("_lang"))
    counts = known.groupBy("_lang").agg(F.count("*").alias("_n"))
    each = min(MAX_DOCUMENTS, max(1, MAX_SAMPLE // max(1, counts.count())))
    at = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    few = known.join(F.broadcast(counts), "_lang").where((F.col("_n") <= 4 * each) | (at * F.col("_n") < 2 * each + 40))  # a row per language, as the model has
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each).select("doc_id", "_lang")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most MAX_SAMPLE ids
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_lang").alias("_lang"))

    def cut(batches):
        for batch in batches:
            found = [some_windows(t) for t in batch.column("text").to_pylist()]
            data = pa.array([None if w is None else w.tobytes() for w in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_lang"), data], ["doc_id", "_lang", "windows"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(cut, f"doc_id {kind}, _lang string, windows binary").where("windows is not null").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in rows], [r["_lang"] for r in rows]


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs' columns by position (c0, c1, ..) with lang_pred and lang_score after them, whatever docs' own are called.

    A null or empty text, one without a letter, or no model: UNKNOWN and 0. Equal texts get equal results; a very long text
    is read in all its windows, CHUNK at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(column):
        names, scores = [UNKNOWN] * len(column), np.zeros(len(column))
        for a, _, texts in pieces.text_blocks(column):
            usable = [i for i, t in enumerate(texts) if t and shared.value and any(map(str.isalpha, t))]
            if usable:
                found, p = shared.value.predict([texts[i] for i in usable])
                for i, name, s in zip(usable, found, p.tolist(), strict=True):
                    names[a + i], scores[a + i] = name, s
        return pa.array(names, pa.string()), pa.array(scores)

    return appended(docs, predict, lang_pred="string", lang_score="double")


def recognised(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of docs, as they are, whose language is told with a score of at least `least`."""
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least)
    return identified(docs, model).where(sure).drop("lang_pred", "lang_score").toDF(*docs.columns)


def languages(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. `und` (score 0): text null or without a letter, or nothing to learn from.

    Only text enters a prediction. The network (a fixed size) is broadcast and every document is read in all its windows
    where it lies: no exchange, no hot key; a worker holds CHUNK windows at a time.
    """
    out = identified(docs.select("doc_id", "text"), fit(*labelled_sample(docs))).withColumnRenamed("c0", "doc_id")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
