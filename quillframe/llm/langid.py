"""Language identification with a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from quillframe.llm.common import ROW, hash_sampled, packed, unpacked

LONGEST = 4  # n-grams of 1 to 4 characters
BUCKET_BITS = 15
TRAIN_PER_LANG = 400  # labelled rows of each language that are learned from: those with the smallest hashes
LANDMARKS_PER_LANG = 50  # of these, the rows the kernel is evaluated against
RIDGE = 0.3
ROWS_AT_ONCE = 256  # rows of a presence matrix
UNKNOWN = "und"
_MIX = np.uint32(2_654_435_761)


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # bucket x language


def spectrum(text: str) -> np.ndarray:
    """The hashed n-grams of a lower-cased text, repeats included."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    rolled, found = codes * _MIX, []
    for n in range(LONGEST):
        if n:
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(31) + codes[n:] * _MIX + np.uint32(n)
        found.append((rolled ^ (rolled >> np.uint32(13))) * _MIX >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(found)


def presence(texts: list[str]) -> np.ndarray:
    """Which n-grams each text has, as a matrix with rows of length one: products of rows are kernel values."""
    seen = np.zeros((len(texts), 1 << BUCKET_BITS), np.float32)
    for row, text in zip(seen, texts, strict=True):
        row[spectrum(text)] = 1
    return seen / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1))


def chunks(texts: list[str]) -> Iterator[list[str]]:
    for i in range(0, len(texts), ROWS_AT_ONCE):
        yield texts[i:i + ROWS_AT_ONCE]


def train(texts: list[str], langs: list[str], landmarks_per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> Model:
    """One-versus-rest ridge regression on Nyström features of the kernel.

    With K the kernel between rows and landmarks and M that among landmarks, the features are
    K M^(-1/2). The regression weights are carried back over the landmarks to the n-grams, since the
    kernel is linear in a row's presence vector: scoring a batch is one matrix product.
    """
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32))
    chosen = [i for name in names for i in [j for j, x in enumerate(langs) if x == name][:landmarks_per_lang]]
    marks = presence([texts[i] for i in chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = np.concatenate([presence(part) @ marks.T for part in chunks(texts)]) @ root
    wanted = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    share = np.array([langs.count(x) for x in langs])  # every language weighs the same
    weighted = features / share[:, None]
    system = weighted.T @ features + ridge / len(texts) * np.eye(features.shape[1])
    solved = np.linalg.solve(system, weighted.T @ wanted)
    return Model(names, (marks.T @ (root @ solved)).astype(np.float32))


def fit(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Model:
    """Learn from ``per_lang`` rows (doc_id, text, lang) of each language, those with the smallest hashes of doc_id.

    Rows without a language or text are left out. At most ``per_lang`` rows per language reach the driver.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found = sorted(hash_sampled(rows, "lang", per_lang).select("lang", "rank", "text").collect())
    return train([r["text"] for r in found], [r["lang"] for r in found])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text and any others) with ``lang_pred`` and ``score``.

    The score is the best regression value, moved from [-1, 1] to [0, 1]. Null texts, texts without a letter
    and all texts under a model without languages are ``und`` with score 0. Input columns called
    lang_pred or score are replaced. Ties go to the first language in order.
    """
    rows = docs.select(packed(docs), F.col("text").alias("_text"))

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.langs else []
        for at in chunks(known):
            values = presence([texts[i] for i in at]) @ model.weights
            for i, best, value in zip(at, values.argmax(axis=1), values.max(axis=1), strict=True):
                langs[i], scores[i] = model.langs[best], float(min(max((value + 1) / 2, 0.0), 1.0))
        return langs, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [ROW, "lang_pred", "score"])

    schema = StructType([rows.schema[ROW]]).add("lang_pred", StringType()).add("score", DoubleType())
    return unpacked(rows.mapInArrow(run, schema), "lang_pred", "score")
