"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features are hashes of words, word pairs, the same of word shapes (what is left of words without lower-case letters),
and word pairs, triples and quadruples that end as they begin, each weighing its share of the text's features; a score
is one sparse dot product.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .line_dedup import mix
from .shared import free_name, raw, ship

BITS = 18
#: Labelled rows that the model is fitted on, at most, and their longest texts.
TRAIN_ROWS = 6000
TRAIN_CHARS = 20_000
EPOCHS = 3
SCALE = 20.0
_LOWER = bytes(range(97, 123)) + bytes(range(128, 256))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))


def _grams(h: np.ndarray, salt: int) -> list[np.ndarray]:
    return [mix(h, salt), mix(h[:-1] * np.uint64(0x100000001B3) + h[1:], salt + 1)]


def _repeats(h: np.ndarray) -> list[np.ndarray]:
    """One feature for all words that the next one repeats, one for the next but one, and so on."""
    return [mix(np.full(int((h[k:] == h[:-k]).sum()), k, dtype=np.uint64), 6) for k in (1, 2, 3)]


def features(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Hashed n-grams, repeats included; none for texts without words."""
    text = text or b""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    h = _hashes(words)
    found = np.concatenate([*_grams(h, 0), *_grams(_hashes(text.translate(None, _LOWER).split()), 2), *_repeats(h)])
    return (found >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with L1 and L2; the last weight is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        size = (1 << bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(rows: list[tuple[bytes | None, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (text, label) rows, in the order given; without rows all weights are zero."""
    model, bias = Ftrl(bits), 1 << bits
    examples = []
    for text, label in rows:
        at, n = np.unique(features(text, bits), return_counts=True)
        x = n * (SCALE / max(1, n.sum()))
        examples.append((np.append(at, bias).astype(np.int32), np.append(x, 1.0).astype(np.float32), float(label)))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            model.learn(*examples[k])
    return model.weights().astype(np.float32)


def score(texts: list[bytes | None], weights: np.ndarray) -> np.ndarray:
    """Probabilities of label 1."""
    bits, bias = (len(weights) - 1).bit_length() - 1, float(weights[-1])
    logits = [bias + SCALE * float(weights[f].mean(dtype=np.float64)) if len(f := features(t, bits)) else bias for t in texts]
    return 1 / (1 + np.exp(-np.clip(logits, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, text: str = "text", key: str = "doc_id", label: str = "quality", max_rows: int = TRAIN_ROWS, max_chars: int = TRAIN_CHARS) -> np.ndarray:
    """Weights from labelled rows for which ``learnable`` (over ``labels``) holds.

    Fitted on at most ``max_rows`` rows with texts of at most ``max_chars`` characters, chosen by a hash of the key.
    Null labels, keys and texts are passed over; a key is learnt once for each distinct label it has, with the least
    text where several rows share it.  Nothing to learn from gives zero weights.
    """
    known = labels.where(learnable).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null").distinct()
    total = known.count()
    order = F.xxhash64(F.lit("train"), "_id")
    share = min(1.0, 1.1 * max_rows / max(1, total))
    known = known.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # About max_rows ids and labels: a bound, so they may be broadcast.
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t")).where(F.col("_t").isNotNull() & (F.char_length("_t") <= max_chars))
    # Copies of a row are one, so that they can't fill the sample, nor the driver.
    found = rows.join(F.broadcast(known), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t")).select("_t", "_y", order.alias("_o"), "_id").toPandas()
    found = found.sort_values(["_o", "_id", "_y", "_t"]).head(max_rows)
    return fit([(t.encode(), y) for t, y in zip(found["_t"], found["_y"], strict=True)])


def with_scores(docs: DataFrame, weights: np.ndarray, text: str = "text", keep_from: float | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier); with ``keep_from``, only rows of at least that score.

    Null and wordless texts get the score of the bias alone; texts are read whole, however long.  Other columns stay; where one is called ``score``, the
    new one gets underscores before it.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(weights)  # 2**BITS floats
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], T.StructField(free_name(docs.columns, "score"), T.DoubleType())])
    names, at = schema.names, docs.columns.index(text)

    def run(batches):
        weights = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                scores = score(raw(part.column(at)), weights)
                out = pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=names)
                yield out if keep_from is None else out.filter(pa.array(scores >= keep_from))

    return docs.mapInArrow(run, schema)
