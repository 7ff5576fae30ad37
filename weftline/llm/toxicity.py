"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of the character n-grams of its words (bytes of the UTF-8 text, a space marking word ends), hashed to buckets.
Embeddings of the buckets and the softmax over their mean are trained together in numpy, so a misspelling that was never seen
still meets the n-grams it shares. The mean is linear, so a trained model scores a text by the mean of one number a bucket.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from weftline.llm.common import claim, give_back, remainder, sampled_labels, without

GRAMS = (3, 4, 5, 6)
BITS = 18
#: Bytes of text whose n-grams are hashed at once.
BLOCK = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def buckets(text: bytes) -> np.ndarray:
    """Bucket of every n-gram of the text, in no order. A word and the spaces around it give n-grams; no n-gram spans words."""
    out = []
    data = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    longest = max(GRAMS)
    for begin in range(0, len(data), BLOCK):
        b = data[begin : begin + BLOCK + longest - 1]
        fresh = min(BLOCK, len(data) - begin)
        space = b == 32
        inner = np.zeros(len(b), np.uint8)  # spaces inside the n-gram so far, beyond its first byte
        h = b.astype(np.uint32) * np.uint32(16777619)
        for n in range(2, longest + 1):
            if len(b) < n:
                break
            m = len(b) - n + 1
            h = (h[:m] ^ b[n - 1 :]) * np.uint32(16777619)
            if n > 2:
                inner = inner[:m] + space[n - 2 : n - 2 + m]
            if n in GRAMS:
                good = inner[:m] == 0
                good[fresh:] = False
                out.append((h[good] * np.uint32(2654435769) + np.uint32(n)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class Model:
    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """Difference of the two logits that each bucket adds, and that of the bias."""
        w = self.softmax[:, 1] - self.softmax[:, 0]
        return (self.embedding @ w).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(texts: list[bytes], labels: np.ndarray, width: int = 6, rounds: int = 6, batch: int = 128, rate: float = 1.0, least_docs: int = 8, seed: int = 7) -> Model:
    """AdaGrad on the cross entropy; embeddings and softmax move together. The same texts in the same order give the same model."""
    rng = np.random.default_rng(seed)
    bags, spread_over, grams = [], np.zeros(1 << BITS, np.int32), np.ones(len(texts), np.float32)
    for k, t in enumerate(texts):
        ids, n = np.unique(buckets(t), return_counts=True)
        spread_over[ids] += 1
        grams[k] = max(1, n.sum())
        bags.append((ids.astype(np.uint32), n.astype(np.min_scalar_type(n.max(initial=0)))))  # most counts fit a byte
    # n-grams of few documents, like those never seen, keep embedding zero: they say nothing, and only remember documents
    known = np.flatnonzero(spread_over >= least_docs)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    for k, (ids, n) in enumerate(bags):  # in place, so that the bags are held once
        at = place[ids]
        bags[k] = at[at >= 0], n[at >= 0]
    embedding, softmax, bias = np.zeros((len(known), width), np.float32), rng.normal(0, 1, (width, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_e, seen_w, seen_b = (np.full(x.shape, 1e-8, np.float32) for x in (embedding, softmax, bias))
    for turn in range(rounds):
        order = rng.permutation(len(bags))
        step = rate * (1 - 0.9 * turn / rounds)
        for i in range(0, len(order), batch):
            own = [k for k in order[i : i + batch] if len(bags[k][0])]
            if not own:
                continue
            ids, part = np.concatenate([bags[k][0] for k in own]), np.concatenate([bags[k][1] / grams[k] for k in own])
            size = np.array([len(bags[k][0]) for k in own])
            at = np.r_[0, np.cumsum(size)[:-1]]
            mean = np.add.reduceat(embedding[ids] * part[:, None], at, axis=0)
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            p /= len(own)
            to_mean, to_w, to_b = p @ softmax.T, mean.T @ p, p.sum(axis=0)
            spread = np.repeat(to_mean, size, axis=0) * part[:, None]
            to_e = np.stack([np.bincount(ids, spread[:, k], len(known)) for k in range(width)], axis=1).astype(np.float32)
            seen_e += to_e**2
            embedding -= step * to_e / np.sqrt(seen_e)
            seen_w += to_w**2
            softmax -= step * to_w / np.sqrt(seen_w)
            seen_b += to_b**2
            bias -= step * to_b / np.sqrt(seen_b)
    whole = np.zeros((1 << BITS, width), np.float32)
    whole[known] = embedding
    return Model(whole, softmax, bias)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 5, per_class: int = 4000, key: str = "doc_id", text: str = "text") -> Model | None:
    """A model from a bounded sample of labelled documents outside fold 0, at most about ``per_class`` of each class.

    Training runs in one task over that sample. Without labelled documents there is no model. Thinning a class shifts the odds of
    the sample against those of the labels, and the bias takes the shift back.
    """
    chosen, odds = sampled_labels(labels, target, folds, per_class, key)
    sample = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t")).join(F.broadcast(chosen), "__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", lambda: None)
        texts, ys = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
        if texts:
            model = train(texts, np.array(ys))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.embedding.astype(np.float16), model.softmax, model.bias))], pa.binary())], names=["model"])
        texts.clear()
        model = None
        give_back()

    rows = sample.repartition(1).sortWithinPartitions("__key", "t").select("t", "__y").mapInArrow(run, "model binary").collect()
    if not rows:
        return None
    e, w, b = pickle.loads(rows[0]["model"])
    b[1] += np.log(odds)
    return Model(e.astype(np.float32), w, b)


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` for every whole text; such input columns are replaced.

    A null or empty text has no n-grams and is scored by the bias alone. Without a model every score is 0.
    """
    base = without(docs, "score", "predicted")
    weights, bias = model.folded() if model else (np.zeros(1 << BITS, np.float32), -np.inf)
    names, at = [*base.columns, "score", "predicted"], base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", lambda: None)
        for b in batches:
            out = np.empty(b.num_rows)
            for i, t in enumerate(b.column(at).cast(pa.binary()).to_pylist()):
                ids = buckets(t) if t else ()
                z = bias + (float(weights[ids].mean(dtype=np.float64)) if len(ids) else 0.0)
                out[i] = 1 / (1 + np.exp(-z)) if z > -500 else 0.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=names)
        give_back()

    schema = StructType([*base.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return base.mapInArrow(run, schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every text's score by a model of the labels outside fold 0. A null text is empty and a null id counts as an empty text for
    its fold; repeated rows are scored each."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't reject, with the columns they had."""
    scored = score(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]), fit(docs, labels))
    return scored.where("predicted = 0").select(*[f"`{c}`" for c in docs.columns])
