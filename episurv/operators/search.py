"""Exact top-k vector search by cosine similarity, with filters, re-ranking and type detection."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episurv.functions import patterns as p
from episurv.functions.codes import STATE_CODES
from episurv.functions.columns import as_col
from episurv.operators.cells import build_cells, search_cells
from episurv.operators.filters import equality_filters
from episurv.operators.vectors import SCORE_DIGITS, Best, element_type, found_schema, ids_of, key_type, matrix_of, unit_rows

# Search depth and re-ranking factors.
TOP_K, MAX_POOL = 5, 15
DOCUMENT_TYPES = ("geographic", "temporal")
SUMMARY_TABLE, SUMMARY_FACTOR = "gold_resumo_geral", 1.2
RECENT_YEARS, RECENT_FACTOR = ("2024", "2025"), 1.1
STATE_FACTOR, MONTH_FACTOR = 1.15, 1.1

# Bytes of query vectors that travel with the tasks of one scan.
CARRIED_BYTES = 16 << 20


def _scan(query_ids: list, queries: np.ndarray, k: int, schema: pa.Schema):
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries, k)
        for batch in batches:
            best.add(ids_of(batch.column(0).to_numpy(zero_copy_only=False)), matrix_of(batch.column(1), dim))
        yield pa.RecordBatch.from_pandas(best.rows(query_ids), schema=schema, preserve_index=False)

    return run


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    query_id: str = "query_id",
    query_vector: str = "vector",
    doc_id: str = "doc_id",
    vector: str = "embedding",
    filters: Mapping[str, str] | None = None,
    dim: int | None = None,
    max_carried: int | None = None,
) -> DataFrame:
    """The k most similar documents of each query: query_id, id, score, rank.

    `dim` is the length of the vectors, by default that of the longest one in the corpus (a small job). Queries and
    documents are treated alike: zero and missing vectors, and those of another length, take no part. Queries of at most CARRIED_BYTES
    (or `max_carried` rows) travel with the tasks of one scan, each of which reads its part of the corpus once and returns its k
    best per query. More of them are searched by cells (see `cells`), where no query passes through the driver. The result is
    exact and the same on either way.
    """
    kept = equality_filters(corpus, filters) if filters else corpus
    query_type, id_type = key_type(queries, query_id), key_type(corpus, doc_id)
    schema, arrow = found_schema(query_type, id_type)
    if dim is None:
        dim = corpus.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 0
    vectors = F.col(query_vector).cast(f"array<{element_type(queries, query_vector)}>")
    q = queries.select(F.col(query_id).cast(query_type).alias("query_id"), vectors.alias("vector"))
    q = q.filter(F.size("vector") == dim)
    size = max_carried or max(1, CARRIED_BYTES // (8 * max(1, dim)))
    few = q.limit(size + 1).collect()  # at most what one scan carries, and one more
    if len(few) > size:
        return search_cells(q, build_cells(kept, dim, doc_id, vector), k).found
    c = kept.filter(F.size(F.coalesce(F.col(vector), F.array().cast("array<float>"))) == dim).select(
        F.col(doc_id).cast(id_type).alias("id"), F.col(vector).alias("vector")
    )
    units, good = unit_rows(np.array([r.vector for r in few], dtype=np.float64).reshape(len(few), dim))
    ids = [r.query_id for r, ok in zip(few, good) if ok]
    found = c.mapInArrow(_scan(ids, units, k, arrow), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def centroids(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per group, as (query_id, vector). Sums combine per task before the shuffle."""
    return (
        df.select(F.col(by).cast("bigint").alias("query_id"), F.posexplode(F.col(vector).cast("array<double>")))
        .groupBy("query_id", "pos")
        .agg(F.avg("col").alias("x"))
        .groupBy("query_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("vector"))
    )


def hybrid(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    text: str = "text",
    doc_id: str = "doc_id",
    vector: str = "embedding",
    max_pool: int = MAX_POOL,
) -> DataFrame:
    """A larger pool re-ranked by source, year, and the state and month named in the question.

    The pool holds twice the wanted rows, at most `max_pool`, and never fewer than wanted.
    """
    pool = knn(queries, corpus, max(k, min(2 * k, max_pool)), doc_id=doc_id, vector=vector).drop("rank")
    asked = queries.select("query_id", F.lower(text).alias("_asked"))
    meta = corpus.select(F.col(doc_id).alias("id"), "source_table", "ano_mes", F.lower("uf").alias("_uf"))
    month = F.coalesce(F.col("ano_mes"), F.lit(""))

    def factor(test: Column, by: float) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), by).otherwise(1.0)

    boosted = (
        F.col("score")
        * factor(F.col("source_table") == SUMMARY_TABLE, SUMMARY_FACTOR)
        * factor(month.contains(RECENT_YEARS[0]) | month.contains(RECENT_YEARS[1]), RECENT_FACTOR)
        * factor((F.col("_uf") != "") & F.contains(F.col("_asked"), F.col("_uf")), STATE_FACTOR)
        * factor((month != "") & F.contains(F.col("_asked"), F.lower(month)), MONTH_FACTOR)
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "id")
    return (
        pool.join(meta, "id")
        .join(asked, "query_id")
        .withColumn("final_score", F.round(boosted, SCORE_DIGITS))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", "id", "score", "final_score", "rank")
    )


def question_document_type(
    text: str | Column,
    states: Sequence[str] = tuple(STATE_CODES),
    geographic: Sequence[str] = tuple(p.GEOGRAPHIC_TERMS),
    temporal: Sequence[str] = tuple(p.TEMPORAL_TERMS),
) -> Column:
    """geographic, temporal or NULL. Terms are whole words; state codes must be in capitals."""

    def word(items: Sequence[str]) -> str:
        return rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(items)})($|[^\p{{L}}\p{{N}}_])"

    named = F.lit(False)
    if states:
        named = as_col(text).rlike(word(states))
    low = F.lower(as_col(text))
    return F.when(named | low.rlike(word(geographic)), "geographic").when(low.rlike(word(temporal)), "temporal")


def typed(
    queries: DataFrame, corpus: DataFrame, k: int = TOP_K, text: str = "text", doc_id: str = "doc_id",
    vector: str = "embedding", wanted: str | None = None, **terms: Sequence[str],
) -> DataFrame:
    """Search among documents of the type each question asks for, or among all: one index, whose cells are apart by type, and one
    search for all questions. `wanted` names a column of types that were taken from the texts before, so that no text moves with
    its vector."""
    asked = queries.withColumn("semantic_type", F.col(wanted) if wanted else question_document_type(text, **terms))
    dim = corpus.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 0
    index = build_cells(corpus, dim, doc_id, vector, kind="semantic_type", kinds=DOCUMENT_TYPES)
    found = search_cells(asked, index, k, wanted="semantic_type").found
    return found.join(asked.select(F.col("query_id"), "semantic_type"), "query_id")
