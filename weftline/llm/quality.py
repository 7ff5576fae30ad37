"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Tokens are runs of letters and digits and runs of other marks, in the case they have, so marks and capitals count. Features are
hashed tokens, pairs and triples of them, present or not, at length one: a score is a sparse dot product.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from weftline.llm.common import remainder, sampled_labels, without

BITS = 20
TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Tokens whose hashes a worker keeps.
KEPT_TOKENS = 400_000


class Hashes(dict):
    """Token to 64-bit hash, worked out once; emptied when it has grown to its bound."""

    def __missing__(self, token: str) -> int:
        if len(self) >= KEPT_TOKENS:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token)
        return h


HASHES = Hashes()


def features(text: str | None, orders: int = 3) -> np.ndarray:
    """The different buckets of the text's token n-grams up to ``orders``."""
    tokens = TOKENS.findall(text) if text else []
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(HASHES.__getitem__, tokens), np.uint64, len(tokens))
    out, g = [h], h
    for n in range(1, orders):
        if len(h) <= n:
            break
        g = (g[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[n:]
        out.append(g * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.unique((np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64))


def train(bags: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, beta: float = 0.1, l1: float = 0.02, l2: float = 0.1, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Weights of the buckets and, last, the bias, after FTRL-proximal updates one document at a time."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rng = np.random.default_rng(seed)

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(rounds):
        for k in rng.permutation(len(bags)):
            ids = np.r_[bags[k], 1 << BITS]
            x = np.full(len(ids), 1 / np.sqrt(max(1, len(ids) - 1)))
            x[-1] = 1.0
            zi, ni = z[ids], n[ids]
            w = weight(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) * alpha**-1 * w
            n[ids] = ni + g * g
    return weight(z, n).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, per_class: int = 4000, key: str = "doc_id", text: str = "text") -> np.ndarray | None:
    """Weights from a bounded sample of labelled documents outside fold 0, at most about ``per_class`` of each class; trained in one task.

    Thinning a class shifts the odds of the sample against those of the labels, and the bias takes the shift back.
    """
    chosen, odds = sampled_labels(labels, target, folds, per_class, key)
    sample = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).join(F.broadcast(chosen), "__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, ys = [], []
        for b in batches:
            bags += [features(t).astype(np.int32) for t in b.column(0).to_pylist()]
            ys += b.column(1).to_pylist()
        if bags:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(bags, np.array(ys, float)))], pa.binary())], names=["model"])

    rows = sample.repartition(1).sortWithinPartitions("__key", "t").select("t", "__y").mapInArrow(run, "model binary").collect()
    if not rows:
        return None
    weights = pickle.loads(rows[0]["model"])
    weights[-1] += np.log(odds)
    return weights


def score(docs: DataFrame, weights: np.ndarray | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` for every whole text; such input columns are replaced.

    A null or empty text is scored by the bias alone. Without weights (no labels) every score is 0.5.
    """
    base = without(docs, "score", "predicted")
    w = weights if weights is not None else np.zeros((1 << BITS) + 1, np.float32)
    names, at = [*base.columns, "score", "predicted"], base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.empty(b.num_rows)
            for i, t in enumerate(b.column(at).to_pylist()):
                ids = features(t)
                z[i] = w[-1] + w[ids].sum(dtype=np.float64) / np.sqrt(max(1, len(ids)))
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=names)

    return base.mapInArrow(run, StructType([*base.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType()))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every text's score by a model of the labels outside fold 0. A null text is empty and a null id counts as an empty text for
    its fold; repeated rows are scored each."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
