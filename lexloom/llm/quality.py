"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal updates.

Words are runs of letters and digits or of other signs; capitals, numbers and a word that repeats
the one before it are written as shapes, so that shouting, sign runs and stuttering are words of
their own. A document is the vector of its hashed 1- and 2-gram frequencies; its score is the
logistic function of a sparse dot product with the weights.

Only the text enters a score. Null and empty texts get the bias alone; repeated rows get the same
score. Very long texts are whole. Of rows tied for the last place in training the smaller text goes
in. Extra columns don't matter. Without labelled rows (an empty table, too) the model is ``None`` and
every score 0.5; an empty table of documents gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, utf8

_TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS = 18
SCALE = 30.0
_REPEAT = np.uint32(zlib.crc32(b"\x01repeat"))


class _Ids(dict):
    """Word -> 32-bit hash of its normal form; bounded."""

    def __missing__(self, word: str) -> int:
        if word.isdigit():
            form = "\x01number"
        elif len(word) > 1 and word.isupper():
            form = "\x01capitals"
        elif not (word[0].isalnum() or word[0] == "_"):
            form = word if len(set(word)) > 1 else word[0] + "\x01" * min(2, len(word) - 1)  # runs of one sign are as good as any longer
        else:
            form = word.lower()
        h = zlib.crc32(form.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


_ids = _Ids()


def features(text: str) -> np.ndarray:
    """Indices of all 1- and 2-grams, repeats included."""
    words = _TOKEN.findall(text)
    h = np.fromiter(map(_ids.__getitem__, words), np.uint32, len(words))
    if len(h) > 1:
        again = h[1:] == h[:-1]
        h[1:][again] = _REPEAT
    pairs = h[:-1] * np.uint32(0x9E3779B1) ^ (h[1:] * np.uint32(0x85EBCA77)) >> np.uint32(7)
    shift = np.uint32(32 - BITS)
    return np.concatenate([h * np.uint32(0xC2B2AE35) >> shift, pairs * np.uint32(0x27D4EB2F) >> shift])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        x = features(text)
        z = self.bias + (SCALE * float(self.weights[x].mean(dtype=np.float64)) if len(x) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the bias is one coordinate without penalty."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**BITS), np.zeros(2**BITS)
        self.bz = self.bn = 0.0

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bz / ((self.beta + self.bn**0.5) / self.alpha)

    def learn(self, text: str, label: int) -> None:
        f = features(text)
        i, c = np.unique(f, return_counts=True)
        x = SCALE * c / max(1, len(f))
        w, b = self.weights(i), self.bias()
        g = 1 / (1 + np.exp(-np.clip(b + float(w @ x), -35, 35))) - label
        gx = g * x
        self.z[i] += gx - (np.sqrt(self.n[i] + gx * gx) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += gx * gx
        self.bz += g - ((self.bn + g * g) ** 0.5 - self.bn**0.5) / self.alpha * b
        self.bn += g * g


def train(docs: DataFrame, labels: DataFrame, sample: int = 6_000, key: str = "doc_id", text: str = "text", label: str = "quality", epochs: int = 2) -> Model | None:
    """Fits on at most ``sample`` labelled documents whose crc32(key) mod 4 is not 2.

    They are the rows of the smallest xxhash64(key), then key and text, so reruns agree; repeated
    identifiers count each. Their number, not the size of a table, bounds the single training task,
    what it keeps between epochs, and the broadcast of their keys. Every epoch sees all of them, in
    one order; the task returns the weights alone.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.crc32(F.col(key).cast("string")) % 4 != 2))
        .groupBy(F.col(key).alias("_k")).agg(F.min(label).cast("int").alias("_y"))
        .withColumn("_o", F.xxhash64("_k")).orderBy("_o", "_k").limit(sample)
    )
    rows = docs.select(F.col(key).alias("_d"), utf8(text).alias("_t")).join(F.broadcast(chosen), F.col("_d") == F.col("_k"))
    rows = rows.select("_o", "_k", "_y", "_t").orderBy("_o", "_k", "_t").limit(sample).repartition(1).sortWithinPartitions("_o", "_k", "_t")

    def fit(batches):
        kept: list[tuple[bytes, int]] = []
        model = Ftrl()
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                model.learn(t.decode("utf-8", "replace"), y)
                if epochs > 1:
                    kept.append((zlib.compress(t, 1), y))
        for _ in range(epochs - 1):
            for t, y in kept:
                model.learn(zlib.decompress(t).decode("utf-8", "replace"), y)
        if model.bn or model.bz:
            w = model.weights(slice(None)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([model.bias()], pa.float64())], names=["weights", "bias"])

    got = rows.select("_y", "_t").mapInArrow(fit, "weights binary, bias double").collect()
    return Model(np.frombuffer(bytes(got[0][0]), np.float32), got[0][1]) if got else None


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``key``, held_out, score, predicted; ``carry`` names columns to keep beside them.

    Only the text goes to Python; the other columns wait in the JVM.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for at in range(0, len(texts), STEP):
                out += [0.5 if model is None else model.score(t.decode("utf-8", "replace")) for t in texts.slice(at, STEP).to_pylist()]
            yield pa.array(out, pa.float64())

    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    scored = docs.select(F.col(key), held, F.arrow_udf(run, "double")(utf8(text)).alias("score"), *(F.col(c).alias(f"_x_{c}") for c in carry))
    return scored.select(key, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"_x_{c}").alias(c) for c in carry))
