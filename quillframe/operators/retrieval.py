"""Retrieval documents, hash embeddings, exact cosine neighbours and hybrid re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators import blocks

# Fixed values.
EMBEDDING_SIZE = 768
DIGEST_BYTES = 32
VECTOR_WEIGHT = 0.7
KEYWORD_WEIGHT = 0.3
WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

QUERIES_PER_PASS = 4096  # query vectors held by one task: 25 MB at 768 doubles
SCORE_DIGITS = 12  # copies of a vector tie exactly, whichever batch they fall in


def rag_documents(schema_rows: DataFrame, stats_rows: DataFrame | None = None, insights: DataFrame | None = None) -> DataFrame:
    """(dataset_id, doc_type, place, content, metadata) for many datasets at once.

    ``schema_rows`` are inferred-schema rows with ``dataset_id``; ``stats_rows`` has one JSON
    text ``stats`` per dataset; ``insights`` has (dataset_id, index, text).
    """
    meta = lambda *pairs: F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    columns = F.array_sort(F.collect_list(F.struct("position", "name", "inferred_type", "unique_count", "null_pct")))
    shape = schema_rows.groupBy("dataset_id").agg(columns.alias("_c"))  # one struct per column
    schema = shape.select(
        "dataset_id", F.lit("schema").alias("doc_type"), F.lit(0).alias("place"),
        F.concat(F.lit("Dataset schema: "), F.to_json(F.struct(F.transform("_c", lambda s: s.dropFields("position")).alias("columns")))).alias("content"),
        meta(F.lit("type"), F.lit("schema")).alias("metadata"))
    samples = F.concat(F.lit("["), F.array_join(F.slice("sample_values", 1, 3), ", "), F.lit("]"))
    column = schema_rows.select(
        "dataset_id", F.lit("column").alias("doc_type"), F.col("position").alias("place"),
        F.concat(F.lit("Column '"), "name", F.lit("': type="), "inferred_type", F.lit(", unique="), F.col("unique_count").cast("string"),
                 F.lit(", nulls="), F.col("null_pct").cast("string"), F.lit("%, samples="), F.coalesce(samples, F.lit("[]"))).alias("content"),
        meta(F.lit("column"), F.col("name")).alias("metadata"))
    out = schema.unionByName(column)
    if stats_rows is not None:
        out = out.unionByName(stats_rows.select(
            "dataset_id", F.lit("stats").alias("doc_type"), F.lit(0).alias("place"),
            F.concat(F.lit("Statistics: "), "stats").alias("content"), meta().alias("metadata")))
    if insights is not None:
        out = out.unionByName(insights.select(
            "dataset_id", F.lit("insight").alias("doc_type"), F.col("index").cast("int").alias("place"),
            F.col("text").alias("content"), meta(F.lit("index"), F.col("index").cast("string")).alias("metadata")))
    return out


def hash_embedding(text: Column) -> Column:
    """SHA-256 bytes of the text scaled to [0, 1], repeated to 768 numbers."""
    digest = F.sha2(text, 256)
    numbers = F.transform(
        F.sequence(F.lit(0), F.lit(DIGEST_BYTES - 1)),
        lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)
    return F.flatten(F.array_repeat(numbers, EMBEDDING_SIZE // DIGEST_BYTES))


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best scores, the smallest ids first among equals."""
    rows = np.arange(len(scores))
    if len(scores) > k:
        rows = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return rows[np.lexsort((ids[rows], -scores[rows]))][:k]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if not pc.all(pc.equal(pc.list_value_length(column), size)).as_py():
        raise ValueError(f"a vector does not have {size} numbers like the queries")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def knn_cosine(
    docs: DataFrame, queries: DataFrame, k: int = 5, doc_id: str = "doc_id", vector: str = "embedding",
    query_id: str = "query_id", query_vector: str = "embedding", split: int = 0,
) -> DataFrame:
    """(query_id, rank, doc_id, score): the exact ``k`` most similar documents per query.

    Every task scores its documents against all queries by one matrix product per Arrow batch, keeps
    the best ``k`` per query while it runs and emits them once at its end: pairs are never written out.
    Null vectors are left out on either side; vectors of another length than the queries' raise.
    More than ``QUERIES_PER_PASS`` queries are dealt into blocks, and the documents meet each block in a scan of its own.
    """
    queries = queries.filter(F.col(query_vector).isNotNull())
    total = queries.count()
    if total > QUERIES_PER_PASS:
        parts = -(-2 * total // QUERIES_PER_PASS)  # half-full on average, so that hashing may be uneven
        slot = F.pmod(F.xxhash64(query_id, F.lit(split)), F.lit(parts))
        out = None
        for i in range(parts):
            part = knn_cosine(docs, queries.filter(slot == i), k, doc_id, vector, query_id, query_vector, split + 1)
            out = part if out is None else out.unionByName(part)
        return out
    doc_kind, query_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, doc_id), (queries, query_id)))
    if total == 0:
        return docs.sparkSession.createDataFrame([], f"`{query_id}` {query_kind}, rank int, `{doc_id}` {doc_kind}, score double")
    asked = queries.select(query_id, F.col(query_vector).cast("array<double>").alias("_q")).orderBy(query_id).collect()
    names = [r[query_id] for r in asked]
    sizes = {len(r["_q"]) for r in asked}
    if len(sizes) > 1:
        raise ValueError(f"the queries have vectors of different lengths: {sorted(sizes)}")
    size = sizes.pop()
    held = _unit(np.array([r["_q"] for r in asked], dtype="float64"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), None)] * len(names)  # scores and ids of each query so far
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = np.asarray(batch.column(0))
            found = np.round(_unit(_matrix(batch.column(1), size)) @ held.T, SCORE_DIGITS)
            for q, (scores, kept) in enumerate(best):
                scores = np.concatenate([scores, found[:, q]])
                every = ids if kept is None else np.concatenate([kept, ids])
                rows = _best_of(scores, every, k)
                best[q] = scores[rows], every[rows]
        counts = [len(scores) for scores, _ in best]
        if any(counts):
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(names)), counts), pa.int32()), pa.array(np.concatenate([i for _, i in best]), type=kind),
                 pa.array(np.concatenate([s for s, _ in best]), pa.float64())], names=["_place", doc_id, "score"])

    vectors = docs.select(doc_id, F.col(vector).cast("array<double>").alias("_v")).filter("_v IS NOT NULL")
    near = vectors.mapInArrow(score, f"_place int, `{doc_id}` {doc_kind}, score double")
    best = blocks.top_per(near, ["_place"], [F.col("score").desc(), F.col(doc_id)], k)
    lookup = docs.sparkSession.createDataFrame(list(enumerate(names)), f"_place int, `{query_id}` {query_kind}")
    return best.join(F.broadcast(lookup), "_place").select(query_id, "rank", doc_id, "score")  # at most QUERIES_PER_PASS rows


def tokens(text: Column) -> Column:
    """Distinct lower-case words split on whitespace."""
    return F.array_distinct(F.filter(F.split(F.lower(text), WHITESPACE), lambda w: w != ""))


def hybrid_rerank(
    docs: DataFrame, queries: DataFrame, k: int = 5, doc_id: str = "doc_id", content: str = "content",
    query_id: str = "query_id", question: str = "question",
) -> DataFrame:
    """(query_id, rank, doc_id, vector_score, keyword_score, score, content).

    The 2k nearest documents by hash embedding, re-ordered by 0.7 · cosine + 0.3 · share of the
    question's words that the whole document contains.
    """
    near = knn_cosine(
        docs.select(doc_id, hash_embedding(F.col(content)).alias("_e")),
        queries.select(query_id, hash_embedding(F.col(question)).alias("_e")),
        2 * k, doc_id, "_e", query_id, "_e")
    pairs = blocks.join_small(docs.select(doc_id, content), near.drop("rank"), [doc_id])
    pairs = pairs.join(queries.select(query_id, question), query_id)
    asked = tokens(F.col(question))
    shared = F.size(F.array_intersect(asked, tokens(F.col(content))))
    scored = pairs.withColumn("keyword_score", shared / F.greatest(F.size(asked), F.lit(1)))
    scored = scored.withColumn("final", F.round(VECTOR_WEIGHT * F.col("score") + KEYWORD_WEIGHT * F.col("keyword_score"), SCORE_DIGITS))
    best = blocks.top_per(scored, [query_id], [F.col("final").desc(), F.col("score").desc(), F.col(doc_id)], k)
    return best.select(query_id, "rank", doc_id, F.col("score").alias("vector_score"), "keyword_score", F.col("final").alias("score"), content)


def context_text(reranked: DataFrame, query_id: str = "query_id", content: str = "content") -> DataFrame:
    """(query_id, context): the re-ranked documents as one text per query."""
    entry = F.format_string("[Context %d | score=%.2f]\n%s", "rank", "score", content)
    return reranked.groupBy(query_id).agg(  # at most k documents per query
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda s: s["e"]), "\n\n").alias("context"))
