"""Vector search against brute force, contexts against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episurv.operators import documents as docs
from episurv.operators import search


def corpus_of(spark, vectors, **columns):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>")


def queries_of(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, vector array<float>")


def brute(queries, corpus, k):
    unit = lambda m: np.float32(m).astype(float) / np.linalg.norm(np.float32(m).astype(float), axis=1, keepdims=True)
    scores = np.round(unit(queries) @ unit(corpus).T, 10)
    return {q: [int(i) for i in np.lexsort((np.arange(len(corpus)), -row))[:k]] for q, row in enumerate(scores)}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("max_carried", [1024, 3])
def test_knn_equals_brute_force(spark, max_carried):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(500, 12))
    corpus[100:200] = corpus[0:100]
    queries = np.vstack([rng.normal(size=(8, 12)), corpus[5:7]])
    got = found(search.knn(queries_of(spark, queries), corpus_of(spark, corpus).repartition(5), 7, max_carried=max_carried))
    assert got == brute(queries, corpus, 7)


def test_bad_vectors_are_no_candidates(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, 0.0]), (5, [-1.0, 0.0])], "doc_id long, embedding array<float>")
    assert found(search.knn(queries_of(spark, [[1, 0]]), df, 5)) == {0: [4, 5]}
    assert search.knn(queries_of(spark, [[1, 0]]).limit(0), df, 5).count() == 0
    assert {r.doc_id for r in docs.wrong_dimensions(df, 2).collect()} == {2, 3}
    filled = docs.fill_missing_vectors(df, 2).filter("doc_id = 2").first()
    assert filled.embedding == [0.0, 0.0] and filled.sem_vetor
    with pytest.raises(Exception, match="vector dimension: expected 2, found 1"):
        docs.require_dimensions(df.filter("doc_id = 3"), 2).collect()


def test_text_ids(spark):
    df = corpus_of(spark, [[1, 0], [0, 1], [1, 1]]).withColumn("doc_id", F.concat(F.lit("geo_"), F.col("doc_id").cast("string")))
    assert found(search.knn(queries_of(spark, [[1, 0]]), df, 2)) == {0: ["geo_0", "geo_2"]}


def test_hybrid_factors(spark):
    rows = [(0, [1.0, 0.0], "x", "2020-01", "SP"), (1, [0.9, 0.43589], search.SUMMARY_TABLE, "2020-02", "RJ"),
            (2, [0.95, 0.31225], "x", "2024-05", "MG"), (3, [0.93, 0.36756], "x", "2019-01", "BA")]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>, source_table string, ano_mes string, uf string")
    asked = queries_of(spark, [[1, 0]]).withColumn("text", F.lit("casos em ba no mês 2024-05"))
    got = {r.id: round(r.final_score / r.score, 4) for r in search.hybrid(asked, df, 4).collect()}
    assert got == {0: 1.0, 1: 1.2, 2: 1.21, 3: 1.15}
    assert found(search.hybrid(asked, df, 2)) == {0: [2, 1]}


def test_question_type_needs_whole_words(spark):
    df = spark.createDataFrame([("casos em SP",), ("se eu soubesse",), ("o estado do Pará",), ("em janeiro",), ("humano",), ("o ano",)], "t string")
    assert [r[0] for r in df.select(search.question_document_type("t")).collect()] == [
        "geographic", None, "geographic", "temporal", None, "temporal"]


def test_typed_search_filters_by_the_type(spark):
    rows = [(0, [1.0, 0.0], "metric"), (1, [0.5, 0.5], "geographic"), (2, [0.9, 0.1], "temporal")]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>, semantic_type string")
    asked = spark.createDataFrame([(0, [1.0, 0.0], "casos em SP"), (1, [1.0, 0.0], "no ano"), (2, [1.0, 0.0], "oi")],
                                  "query_id long, vector array<float>, text string")
    assert found(search.typed(asked, df, 1)) == {0: [1], 1: [2], 2: [0]}


def test_context_stops_at_the_first_overflow(spark):
    rows = [(1, 1, "a" * 50, "t", "s", "d1"), (1, 2, "b" * 500, "t", "s", "d2"), (1, 3, "c", "t", "s", "d3"), (2, 1, "x" * 900, None, None, "d4")]
    df = spark.createDataFrame(rows, "query_id long, rank int, content string, source_table string, semantic_type string, doc_id string")
    plain = {r.query_id: r for r in docs.build_context(df, "query_id", max_length=300).collect()}
    assert plain[1].documentos == 1 and "**DOCUMENTO 1:**\nFonte: t\nTipo: s\n\n" + "a" * 50 in plain[1].contexto
    assert plain[2].documentos == 0 and plain[2].contexto == ""
    cited = {r.query_id: r for r in docs.context_with_citations(df, "query_id", max_length=300).collect()}
    assert list(cited[1].citacoes) == ["[1]", "[2]"] and cited[1].contexto == "[1] " + "a" * 50 + "\n\n"
    assert '"source_table":"N/A"' in cited[2].citacoes["[1]"]


@pytest.mark.parametrize("copies", [1, 40])
def test_queries_of_other_lengths_take_no_part(spark, copies):
    queries = [[1.0, 0.0], [1.0, 2.0, 3.0], [0.0, 0.0], [0.0, 1.0]] * copies
    got = found(search.knn(queries_of(spark, queries), corpus_of(spark, [[1, 0], [0, 1], [1, 1]]), 1, max_carried=5))
    assert got == {i: [int(q[1])] for i, q in enumerate(queries) if len(q) == 2 and any(q)}


def test_hybrid_gives_all_rows_wanted(spark):
    asked = queries_of(spark, [[1, 0]]).withColumn("text", F.lit("x"))
    docs = [[1, i] for i in range(40)]
    df = corpus_of(spark, docs).withColumns({c: F.lit("") for c in ("source_table", "ano_mes", "uf")})
    assert len(found(search.hybrid(asked, df, 25))[0]) == 25
