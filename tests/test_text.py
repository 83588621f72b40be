"""Text rules with their own word lists, on literal rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from episurv.functions import patterns as p
from episurv.functions.documents import fixed, head_and_tail, parse_metadata, thousands
from episurv.operators import documents as docs
from episurv.operators import guard
from episurv.operators import textrules as tx


def texts(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, text string")


def column(df, expr):
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


def test_routing_examples(spark):
    df = texts(
        spark,
        "Quantos casos de SRAG em janeiro de 2025?",
        "Por que aumentou?",
        "Ranking de UFs e explicação das tendências",
        "Comparar a evolução entre estados",
        "bom dia",
        "Casos em SP e RJ em março de 2024",
    )
    rows = {r.id: r for r in tx.route_questions(df).collect()}
    assert rows[0].estrategia == "sql_only" and rows[0].filtro_ano_mes == "2025-01" and rows[0].confianca == 0.9
    assert rows[1].intencoes == ["analytical"] and rows[1].estrategia == "rag_only" and rows[1].tabelas == ["resumo_geral"]
    assert rows[2].intencoes == ["geographic"] and rows[2].tabelas == ["metricas_geograficas", "series_temporais"]
    assert rows[3].intencao == "mixed" and rows[3].estrategia == "hybrid" and rows[3].tipo_documento == "temporal"
    assert rows[4].intencoes == ["factual"] and rows[4].confianca == 0.6 and rows[4].filtro_uf is None
    assert rows[5].filtro_uf == "SP" and rows[5].filtro_ano_mes == "2024-03"
    assert "metricas_geograficas" in rows[5].tabelas


def test_lower_case_words_are_no_states(spark):
    df = texts(spark, "se eu for para o estado", "casos em SE", "MÊS em ÉSP", "SPX")
    assert column(df, tx.state_filter("text")) == [None, "SE", None, None]


def test_word_boundaries_know_accents(spark):
    df = texts(spark, "o número cresceu", "onúmero", "numero")
    assert column(df, tx.matches_any(F.col("text"), [r"\b(número)\b"])) == [True, False, False]


def test_confidence_is_clamped(spark):
    df = texts(spark, "qual o total por que comparar tendência", "oi", "")
    assert column(df, tx.route_confidence("text", F.array(F.lit("a")))) == [0.9, 0.6, 0.6]
    many = F.array(*[F.lit(x) for x in "abc"])
    assert column(df, tx.route_confidence("text", many)) == [0.75, 0.5, 0.5]


def test_question_types(spark):
    rows = tx.question_types(texts(spark, "Qual o mês com maior alta?", "Onde?", "xyz")).orderBy("id").collect()
    assert (rows[0].tipo_principal, rows[0].tipo_preferido, rows[0].complexidade) == ("factual", "temporal", "complex")
    assert (rows[1].tipos, rows[1].tipo_preferido, rows[1].complexidade) == (["geographic"], "geographic", "simple")
    assert (rows[2].tipos, rows[2].tipo_principal) == ([], "general")


def test_answer_quality(spark):
    df = spark.createDataFrame(
        [(0, "Não há dados suficientes para isso", 2), (1, "curto", 0), (2, None, 1), (3, "Foram 10 casos em janeiro de 2024", 1)],
        "id int, a string, n int",
    )
    rows = tx.answer_quality(df, "a", "n").orderBy("id").collect()
    assert [r.nota for r in rows] == [0.7, 0.4, 0.7, 1.0]
    assert rows[0].problemas == [p.ISSUE_GENERIC] and rows[3].valida


def test_entities(spark):
    df = texts(spark, "Em SP e RJ, e de novo SP: alta de 12,5% e 30%", "ésp 5 mil casos, 3.5 milhões")
    assert column(df, tx.entities("text")) == [["RJ", "SP", "12,5%", "30%"], []]
    assert column(df, tx.numbers("text"))[1] == ["5 mil", "3.5 milhões"]


def test_source_order_wins(spark):
    df = texts(spark, "https://drauziovarella.uol.com.br/x", "http://www.SAUDE.gov.br/a", "https://medscape.com", "https://blog.net/a/b", "")
    assert column(df, tx.source_trust("text")) == ["mainstream", "official", "specialized", "other", "other"]
    assert column(df, tx.source_name("text")) == ["UOL", "Ministério da Saúde", "medscape.com", "blog.net", ""]


def test_articles_get_defaults_and_a_hash(spark):
    df = spark.createDataFrame([(None, None, "Conteúdo " * 100, None), ("Título", "https://who.int/x", "SRAG casos UTI", "2025-01-01")],
                               "t string, u string, c string, d string")
    rows = tx.score_articles(tx.parse_results(df, "t", "u", "c", "d")).collect()
    assert rows[0].title == "" and rows[0].published_date == "N/A" and len(rows[0].snippet) == 300
    assert rows[1].hash == hashlib.md5("títulosrag casos uti".encode()).hexdigest()
    assert rows[1].relevance_score == pytest.approx(0.72) and rows[1].relevance == "high"
    assert rows[0].relevance_score == pytest.approx(0.3) and rows[0].relevance == "low"
    assert [r.title for r in tx.relevant_articles(tx.score_articles(tx.parse_results(df, "t", "u", "c", "d"))).collect()] == ["Título"]


def test_redaction_in_order(spark):
    df = texts(spark, "CPF 123.456.789-01", "12345678901", "12.345.678/0001-99", "x(11) 98765-4321", "ligue (11) 98765-4321",
               "Ana Silva", "Évora Ângela e José Érico", "05/06/2024", "01310-100")
    out = guard.redact_pii(df, ["text"], counts=True).orderBy("id").collect()
    assert [r.text for r in out] == [
        "CPF [REDACTED]_CPF", "[REDACTED]_CPF_SEM_FORMATO", "[REDACTED]_CNPJ", "x[REDACTED]_TELEFONE", "ligue (11) 98765-4321",
        "[REDACTED]_NOME", "[REDACTED]_NOME e [REDACTED]_NOME", "[REDACTED]_DATA", "[REDACTED]_CEP"]
    assert out[6].text_pii_nome == 2 and out[0].text_pii_cpf == 1 and out[0].text_pii_cpf_sem_formato == 0


def test_sanitize_drops_personal_columns(spark):
    df = spark.createDataFrame([("1", "Ana Silva", 3)], "NU_NOTIFIC string, nota string, n int")
    assert guard.sanitize(df).collect()[0].asDict() == {"nota": "[REDACTED]_NOME", "n": 3}
    assert spark.range(1).select(guard.pii_mentions(F.lit("select NU_CPF, dt_nasc"))).first()[0] == ["nu_cpf", "dt_nasc"]


def test_sql_rules(spark):
    ok = "SELECT * FROM gold.gold_resumo_geral LIMIT 10"
    cases = [
        (ok, None),
        (ok.replace("10", "10000"), None),
        (ok.replace("10", "10001"), "MISSING_LIMIT"),
        (ok.replace("10", "9" * 45), "MISSING_LIMIT"),
        ("SELECT * FROM gold_resumo_geral", "MISSING_LIMIT"),
        ("SELECT TOP 5 * FROM gold_resumo_geral", None),
        ("SELECT concat(a) FROM gold_resumo_geral LIMIT 1", "SQL_INJECTION"),
        (ok + " -- x", "SQL_INJECTION"),
        ("SELECT * FROM gold_resumo_geral UNION  SELECT 1 LIMIT 1", "SQL_INJECTION"),
        ("DROP TABLE gold_resumo_geral", "FORBIDDEN_COMMAND"),
        ("SELECT dropdown FROM gold_resumo_geral LIMIT 1", None),
        ("SHOW gold_resumo_geral LIMIT 1", "NON_SELECT_QUERY"),
        ("WITH gold_resumo_geral LIMIT 1", "NON_SELECT_QUERY"),
        ("\n with x as (select 1) select * from gold_resumo_geral limit 1", None),
        ("SELECT * FROM silver.x JOIN gold_resumo_geral LIMIT 1", "UNAUTHORIZED_TABLE"),
        ("SELECT * FROM other LIMIT 1", "UNAUTHORIZED_TABLE"),
        (ok + " " * 5000, "QUERY_TOO_LONG"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, query string")
    rows = guard.validate_sql(df).orderBy("id").collect()
    assert [r.violation_type for r in rows] == [v for _, v in cases]
    assert [r.valida for r in rows] == [v is None for _, v in cases]
    records = guard.violations(guard.validate_sql(df))
    assert records.count() == sum(v is not None for _, v in cases)
    assert records.agg(F.max(F.length("query"))).first()[0] <= 200


def test_input_rules(spark):
    df = texts(spark, "casos em SP", "x; drop table", "a -- b", "' or '1'='1", "a;b;c;d;e;f;g", "it's \"ok\"")
    assert column(df, guard.input_problem("text").isNull()) == [True, False, False, False, False, True]


def test_formats(spark):
    row = spark.range(1).select(
        thousands(F.lit(1234567)), fixed(F.lit(2.675)), fixed(F.lit(5.0), signed=True), fixed(F.lit(None).cast("double")),
        docs.plain_number(F.lit(12345678.0)), docs.plain_number(F.lit(33.33)),
        head_and_tail(F.lit("a" * 300 + "b" * 300), 500),
    ).first()
    assert list(row)[:6] == ["1,234,567", "2.68", "+5.00", "N/A", "12345678.0", "33.33"]
    assert row[6] == "a" * 240 + " ... [TRUNCADO 600 chars] ... " + "b" * 240


def test_broken_metadata_is_empty(spark):
    df = texts(spark, '{"a": "b"}', "x{", None)
    assert column(df, parse_metadata("text")) == [{"a": "b"}, {}, {}]


def test_blank_documents_are_dropped_and_ids_filled(spark):
    df = spark.createDataFrame([("1", " a\n"), (None, "b"), ("", "b"), ("4", " \n"), ("5", None)], "doc_id string, content string")
    rows = docs.validate_documents(df).collect()
    assert [(r.doc_id[:5], r.content) for r in rows] == [("1", "a"), ("auto_", "b"), ("auto_", "b")]
    assert rows[1].doc_id == rows[2].doc_id


def test_first_month_document_has_no_growth(spark):
    df = spark.createDataFrame([("2024-01", 1234, 1.5, 2.0, 3.25, None), ("2024-02", 10, 1.5, None, 3.25, -12.5)],
                               "ano_mes string, total_casos long, taxa_mortalidade double, taxa_uti double, taxa_vacinacao double, taxa_crescimento double")
    rows = {r.doc_id: r.content for r in docs.month_documents(df).collect()}
    assert "CRESCIMENTO MENSAL: N/A%" in rows["temporal_2024-01"] and "1,234 notificações" in rows["temporal_2024-01"]
    assert "CRESCIMENTO MENSAL: -12.50%" in rows["temporal_2024-02"]
    assert docs.month_documents(df, months=1).first().doc_id == "temporal_2024-02"
