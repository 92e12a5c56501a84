"""Toxicity from subword embeddings that are averaged over windows of words into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from quillframe.llm.common import ROW, hash_sampled, packed, unpacked

GRAMS = (3, 4, 5)  # bytes of a subword, a blank at either end included
BUCKET_BITS = 17
WIDTH = 8  # of an embedding
WINDOW = 16  # words that are averaged; scoring windows overlap by half
TRAIN_PER_CLASS = 2000  # labelled rows of each class that are learned from: those with the smallest hashes
ROUNDS, STEPS, BATCH, RATE, DECAY = 4, 100, 512, 0.5, 1e-6  # steps: in each round, whole epochs
HARD = 3
LEAST_SUBWORDS = 100  # a window counts as this many at least, so that one word alone weighs little
LEVEL, FALSE_ALARMS = 0.7, 0.012  # the share of held-back clean rows that reaches the level, for models of half the rows
_MIX = np.uint32(2_654_435_761)


class Model(NamedTuple):
    weights: np.ndarray  # of each subword: its embedding times the difference of the classes' weights
    bias: float
    prior: float  # share of the toxic class, the score of a text without words


def subwords(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, word) of every subword of the lower-cased text, sorted by size then place, and the number of words."""
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" ", np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = blank[:-1] & ~blank[1:]
    number = np.cumsum(np.r_[starts, False]) - 1  # the word that the next byte belongs to
    codes = np.where(blank, 32, raw).astype(np.uint32)
    rolled, buckets, words = codes, [], []
    solid = ~blank  # solid[i]: no blank inside the gram that starts at i
    for n in range(2, max(GRAMS) + 1):
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * _MIX + codes[n - 1:]
        if n == 2:
            continue
        inner = solid[1:len(solid) - 1] if n == 3 else inner[:-1] & solid[n - 2:len(solid) - 1]
        if n in GRAMS:
            at = np.flatnonzero(inner)
            mixed = (rolled[at] + np.uint32(n)) * _MIX
            buckets.append((mixed ^ (mixed >> np.uint32(15))) * _MIX >> np.uint32(32 - BUCKET_BITS))
            words.append(number[at])
    return np.concatenate(buckets), np.concatenate(words), int(starts.sum())


def fresh(text: str | None) -> np.ndarray:
    """For each word whether it is none of the ``WINDOW`` - 1 words before it."""
    seen, found = {}, []
    for i, w in enumerate((text or "").encode("utf-8", "surrogatepass").lower().split()):
        found.append(i - seen.get(w, -WINDOW) >= WINDOW)
        seen[w] = i
    return np.array(found, bool)


class Bag(NamedTuple):
    ids: np.ndarray  # subwords of the words that are fresh
    size: int  # all subwords, ``LEAST_SUBWORDS`` at least


def windows(text: str | None) -> list[Bag]:
    """The subwords of every ``WINDOW`` words, without overlap, for training."""
    buckets, words, n = subwords(text)
    at, new = words // WINDOW, fresh(text)
    order = np.argsort(at, kind="stable")
    parts = np.split(order, np.searchsorted(at[order], np.arange(1, -(-n // WINDOW))))
    bags = (Bag(buckets[p[new[words[p]]]], max(len(p), LEAST_SUBWORDS)) for p in parts if len(p))
    return [b for b in bags if len(b.ids)]


def logit(model: Model, text: str | None) -> float | None:
    """The largest class difference of any window; None without words. A word that repeats within a window counts once."""
    buckets, words, n = subwords(text)
    if not n or not len(buckets):
        return None
    new = fresh(text)[words]
    sums = np.bincount(words[new], model.weights[buckets[new]], n)
    counts = np.bincount(words, minlength=n)
    half = WINDOW // 2
    begins = np.arange(0, max(1, n - half), half)
    ends = np.minimum(begins + WINDOW, n)
    total, many = np.r_[0, np.cumsum(sums)], np.r_[0, np.cumsum(counts)]
    means = (total[ends] - total[begins]) / np.maximum(many[ends] - many[begins], LEAST_SUBWORDS)
    return float(means.max() + model.bias)


def _descend(bags: list[Bag], labels: np.ndarray, state: dict, rng: np.random.Generator) -> None:
    """Adagrad on embeddings and class weights together, over shuffled batches."""
    table, out, bias = state["table"], state["out"], state["bias"]
    batches = -(-len(bags) // BATCH)
    for _ in range(-(-STEPS // batches)):
        for part in np.array_split(rng.permutation(len(bags)), batches):
            ids = np.concatenate([bags[i].ids for i in part])
            own, sizes = np.array([len(bags[i].ids) for i in part]), np.array([bags[i].size for i in part])
            begins = np.r_[0, np.cumsum(own)[:-1]]
            mean = np.add.reduceat(table[ids], begins, axis=0) / sizes[:, None]
            scores = mean @ out + bias
            scores -= scores.max(axis=1, keepdims=True)
            chance = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
            error = (chance - np.eye(2)[labels[part]]) / len(part)
            pull = np.repeat((error @ out.T) / sizes[:, None], own, axis=0)
            met, place = np.unique(ids, return_inverse=True)  # the other subwords keep their embeddings
            grad = np.stack([np.bincount(place, pull[:, d], len(met)) for d in range(WIDTH)], axis=1) + DECAY * table[met]
            for name, at, g in (("table", met, grad), ("out", slice(None), mean.T @ error), ("bias", slice(None), error.sum(axis=0))):
                state[f"{name}_seen"][at] += g * g
                state[name][at] -= RATE * g / np.sqrt(state[f"{name}_seen"][at] + 1e-10)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Learn from documents whose label holds for an unknown part of them.

    All windows of a clean document are clean. The first round takes all windows of toxic documents as toxic and
    every ``HARD``-th clean window. Each further round takes the windows that the model so far finds
    the most toxic: a sixteenth, then less, of a toxic document (one at least) and one in ``HARD`` of the clean ones.
    """
    prior = (sum(labels) + 1) / (len(labels) + 2)
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    state = {"table": rng.normal(0, 0.1, (size, WIDTH)), "out": rng.normal(0, 0.1, (WIDTH, 2)), "bias": np.zeros(2)}
    state |= {f"{k}_seen": np.zeros_like(v) for k, v in state.items()}
    toxic = [w for w in (windows(t) for t, y in zip(texts, labels, strict=True) if y) if w]
    clean = [x for t, y in zip(texts, labels, strict=True) if not y for x in windows(t)]
    if not toxic or not clean:
        return Model(np.zeros(size), float(np.log(prior / (1 - prior))), prior)
    ones, zeros = [x for doc in toxic for x in doc], clean[::HARD]
    for turn in range(ROUNDS):
        if turn:
            weights, _ = _collapsed(state)
            ones = [x for doc in toxic for x in _worst(doc, weights, max(1, len(doc) // (8 << turn)))]
            zeros = _worst(clean, weights, -(-len(clean) // HARD))
        _descend(ones + zeros, np.r_[np.ones(len(ones), int), np.zeros(len(zeros), int)], state, rng)
    return Model(*_collapsed(state), prior)


def _worst(bags: list[Bag], weights: np.ndarray, n: int) -> list[Bag]:
    order = np.argsort([-weights[x.ids].sum() / x.size for x in bags], kind="stable")
    return [bags[i] for i in order[:n]]


def calibrated(texts: list[str], labels: list[int]) -> Model:
    """A model of all rows whose bias puts ``LEVEL`` where models of either half find ``FALSE_ALARMS`` of the other half's clean rows."""
    model = train(texts, labels)
    clean = []
    for half in range(2):
        part = train(texts[half::2], labels[half::2])
        found = (logit(part, t) for t, y in zip(texts[1 - half::2], labels[1 - half::2]) if not y)
        clean += [x for x in found if x is not None]
    if not clean or len(set(labels)) < 2:
        return model
    return model._replace(bias=model.bias + float(np.log(LEVEL / (1 - LEVEL)) - np.quantile(clean, 1 - FALSE_ALARMS)))


def _collapsed(state: dict) -> tuple[np.ndarray, float]:
    apart = state["out"][:, 1] - state["out"][:, 0]
    return state["table"] @ apart, float(state["bias"][1] - state["bias"][0])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model:
    """Learn from ``per_class`` rows of each class: ``docs`` (doc_id, text) joined to ``labels`` (doc_id, toxic).

    Those with the smallest hashes of doc_id are taken, one text each (the smallest), so at most twice ``per_class`` texts reach the driver.
    Rows without text or label are left out.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1))
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id").distinct()
    chosen = hash_sampled(chosen, "toxic", per_class).drop("rank")
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = sorted(rows.collect())  # 2 x per_class rows
    return calibrated([r["text"] for r in found], [r["toxic"] for r in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text and any others) with ``score``, the chance of the toxic class of its worst window.

    Null and empty texts get the share of the toxic class. Texts are read whole, however long; repeated rows score alike. An input
    column called score is replaced; the others stay.
    """
    rows = docs.select(packed(docs), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [logit(model, t.as_py()) for t in batch.column(1)]
            scores = [model.prior if x is None else float(1 / (1 + np.exp(-np.clip(x, -500, 500)))) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [ROW, "score"])

    schema = StructType([rows.schema[ROW]]).add("score", DoubleType())
    return unpacked(rows.mapInArrow(run, schema), "score")
