"""Text rules, redaction, documents and vector search on the text tables.

The text tables hold four languages and no Portuguese, so the rules run here with words and hosts
that occur; the fixed word lists are exercised on literal rows in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from episurv.functions import patterns as p
from episurv.functions import templates as t
from episurv.functions.codes import STATE_CODES
from episurv.functions.documents import content_hash, head_and_tail
from episurv.operators import documents as docs
from episurv.operators import audit, cells, guard, search, usage
from episurv.operators import textrules as tx
from episurv.plans import gold
from episurv.plans.cases import table
from episurv.plans.silver import silver_of, written_silver
from episurv.registry import query
from episurv.registry.gold_queries import AGE_SEX, KPI_LONG, KPIS, MONTHLY, STATES
from episurv.registry.sql import SILVER

B, E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def whole(*words: str) -> str:
    """Pattern of whole words that both regex engines read alike."""
    return f"{B}({'|'.join(words)}){E}"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hit(col: str, pattern: str, options: str = "i") -> str:
    return f"regexp_matches({col}, {sql_text(pattern)}, '{options}')"


def any_sql(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def has(col: str, words) -> str:
    return any_sql(f"contains({col}, {sql_text(w)})" for w in words)


# --- questions ------------------------------------------------------------------------------

INTENTS = {
    "factual": [whole("the", "der", "el"), whole("which")],
    "analytical": [whole("que", "weil")],
    "temporal": [whole("des", "zu"), r"ation.*(ment|keit)"],
    "geographic": [whole("le", "ein")],
    "explanatory": [whole("und", "of")],
}
WORD_TABLES = {"metricas_geograficas": ["ville", "heit"], "series_temporais": ["tion", "für"]}
CONFIDENT = ["qu", "sch"]
TYPES = {"factual": ["the", "der"], "temporal": ["tion", "heit"], "geographic": ["eau", "von"], "explanatory": ["qu"]}
PHRASES = ["tion", "heit"]
MONTHS = ["the", "der", "que"]
STATES_SEEN = ["The", "Le", "In", "Que"]

_INTENT_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN {any_sql(hit('text', x) for x in ps)} THEN '{label}' END" for label, ps in INTENTS.items()
) + "], lambda x: x IS NOT NULL)"
ROUTED = f"""WITH i AS (SELECT conv_id, turn, text, {_INTENT_LIST} AS found FROM conversations),
  c AS (SELECT conv_id, turn, text, CASE WHEN len(found) = 0 THEN ['factual'] ELSE found END AS cls FROM i)"""
_JSON_LIST = "CAST(to_json({}) AS VARCHAR)"


def _strategy(cls: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in p.INTENT_STRATEGY.items())
    return f"CASE WHEN len({cls}) > 1 THEN 'hybrid' ELSE CASE {cls}[1] {cases} END END"


@query("r15_classify_intent", f"{ROUTED} SELECT conv_id, turn, {_JSON_LIST.format('cls')} AS intencoes FROM c")
def r15(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.classify_intent("text", INTENTS).alias("intencoes"))


@query("r16_choose_strategy", f"{ROUTED} SELECT conv_id, turn, {_strategy('cls')} AS estrategia FROM c")
def r16(spark, d):
    intents = tx.classify_intent("text", INTENTS)
    return table(spark, d, "conversations").select("conv_id", "turn", tx.choose_strategy(intents).alias("estrategia"))


def _tables_sql() -> str:
    parts = [f"CASE WHEN list_contains(cls, '{i}') THEN {ts!r} ELSE CAST([] AS VARCHAR[]) END" for i, ts in p.INTENT_TABLES.items()]
    parts += [f"CASE WHEN {has('lower(text)', ws)} THEN ['{tb}'] ELSE CAST([] AS VARCHAR[]) END" for tb, ws in WORD_TABLES.items()]
    return f"list_sort(list_distinct(flatten([{', '.join(parts)}])))"


@query("r17_target_tables", f"{ROUTED} SELECT conv_id, turn, {_JSON_LIST.format(_tables_sql())} AS tabelas FROM c")
def r17(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", tx.target_tables("text", tx.classify_intent("text", INTENTS), by_word=WORD_TABLES).alias("tabelas")
    )


_STATE_SQL = f"nullif(regexp_extract(text, {sql_text(whole(*STATES_SEEN))}, 2), '')"
_MONTH_NO = "CASE " + " ".join(f"WHEN contains(lower(text), '{m}') THEN '{i:02d}'" for i, m in enumerate(MONTHS, 1)) + " END"
_YEAR = f"nullif(regexp_extract('20' || (10 + conv_id % 80) || ' ' || text, {sql_text(B + '(20[0-9]{2})' + E)}, 2), '')"


@query(
    "r18_extract_filters",
    f"SELECT conv_id, turn, {_STATE_SQL} AS filtro_uf, {_YEAR} || '-' || {_MONTH_NO} AS filtro_ano_mes FROM conversations",
)
def r18(spark, d):
    dated = F.concat(F.lit("20"), (F.col("conv_id") % 80 + 10).cast("string"), F.lit(" "), F.col("text"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", tx.state_filter("text", STATES_SEEN).alias("filtro_uf"),
        tx.month_filter(dated, MONTHS).alias("filtro_ano_mes"),
    )


_CONFIDENCE = f"""round(greatest(0.5, least(0.95, 0.7::DOUBLE + CASE WHEN {has('lower(text)', CONFIDENT)} THEN 0.2::DOUBLE ELSE 0 END
  - CASE WHEN len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) < 4 THEN 0.1::DOUBLE ELSE 0 END
  - CASE WHEN len(cls) > 2 THEN 0.15::DOUBLE ELSE 0 END)), 2)"""
_DOC_TYPE = "CASE list_filter(cls, lambda x: x IN ('temporal', 'geographic', 'demographic', 'explanatory'))[1] " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in p.INTENT_DOCUMENT_TYPE.items()
) + " END"


@query(
    "r19_route_confidence",
    f"""{ROUTED} SELECT conv_id, turn, {_JSON_LIST.format('cls')} AS intencoes, {_strategy('cls')} AS estrategia,
    CASE WHEN len(cls) = 1 THEN cls[1] ELSE 'mixed' END AS intencao, {_JSON_LIST.format(_tables_sql())} AS tabelas,
    CASE WHEN {_strategy('cls')} <> 'rag_only' THEN {_STATE_SQL} END AS filtro_uf, CAST(NULL AS VARCHAR) AS filtro_ano_mes,
    CASE WHEN {_strategy('cls')} <> 'sql_only' THEN {_DOC_TYPE} END AS tipo_documento, {_CONFIDENCE} AS confianca FROM c""",
)
def r19(spark, d):
    return tx.route_questions(
        table(spark, d, "conversations"), "text", INTENTS, by_word=WORD_TABLES, keywords=CONFIDENT, states=STATES_SEEN, months=MONTHS
    ).drop("role", "text")


_TYPE_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN {has('lower(text)', ws)} THEN '{label}' END" for label, ws in TYPES.items()
) + "], lambda x: x IS NOT NULL)"


@query(
    "r13_question_types",
    f"""WITH q AS (SELECT conv_id, turn, {_TYPE_LIST} AS tipos FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, {_JSON_LIST.format('tipos')} AS tipos, coalesce(tipos[1], 'general') AS tipo_principal,
      CASE WHEN list_contains(tipos, 'temporal') THEN 'temporal' WHEN list_contains(tipos, 'geographic') THEN 'geographic' END AS tipo_preferido,
      CASE WHEN len(tipos) > 1 THEN 'complex' ELSE 'simple' END AS complexidade FROM q""",
)
def r13(spark, d):
    asked = table(spark, d, "conversations").filter(F.col("role") == "user")
    return tx.question_types(asked, "text", TYPES).drop("role", "text")


_ISSUES = f"""list_filter([CASE WHEN length(text) < 20 THEN '{p.ISSUE_SHORT}' END, CASE WHEN conv_id % 3 = 0 THEN '{p.ISSUE_NO_SOURCE}' END,
  CASE WHEN {has('lower(text)', PHRASES)} AND conv_id % 3 > 0 THEN '{p.ISSUE_GENERIC}' END], lambda x: x IS NOT NULL)"""


@query(
    "r14_answer_quality",
    f"""WITH a AS (SELECT conv_id, turn, {_ISSUES} AS problemas, conv_id % 3 AS fontes FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, fontes, {_JSON_LIST.format('problemas')} AS problemas, len(problemas) = 0 AS valida,
      round(1 - len(problemas) * 0.3::DOUBLE, 1) AS nota FROM a""",
)
def r14(spark, d):
    answers = table(spark, d, "conversations").filter(F.col("role") == "assistant").withColumn("fontes", F.col("conv_id") % 3)
    return tx.answer_quality(answers, "text", "fontes", PHRASES).drop("role", "text")


# --- guards ---------------------------------------------------------------------------------

# One query text per kind of rule, filled in from the event.
_TEXTS = [
    "SELECT * FROM gold.gold_resumo_geral WHERE k = {k} LIMIT 10",
    "select ano_mes from gold.gold_metricas_temporais limit {k}000",
    "WITH x AS (SELECT * FROM gold_metricas_geograficas) SELECT * FROM x LIMIT {k}",
    "SELECT * FROM gold_resumo_geral WHERE k = {k}",
    "SELECT * FROM silver.cases JOIN gold_resumo_geral USING (k) LIMIT {k}",
    "SELECT * FROM events WHERE k = {k} LIMIT 5",
    "DROP TABLE gold_resumo_geral",
    "SELECT 1; drop table gold_series_temporais",
    "SELECT concat('a', k) FROM gold_resumo_geral LIMIT {k}",
    "SELECT * FROM gold_resumo_geral -- {k}",
    "SHOW TABLES LIKE 'gold_resumo_geral' LIMIT {k}",
    "WITH gold_resumo_geral LIMIT {k}",
    "  SELECT TOP 5 * FROM vw_top10_ufs WHERE k = {k}",
    "SELECT * FROM gold_resumo_geral WHERE k IN ({many}) LIMIT 10",
]
_MANY = ", 1234567" * 600


def _query_log(spark, d):
    texts = F.array(*[F.lit(x.replace("{many}", "{k}" + _MANY)) for x in _TEXTS])
    template = F.element_at(texts, (F.col("event_id") % len(_TEXTS) + 1).cast("int"))
    out = F.replace(template, F.lit("{k}"), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select(F.col("event_id").alias("query_id"), "user_id", "event_type", F.col("ts").alias("timestamp"), out.alias("query"))


_LOG_SQL = "CASE event_id % {} ".format(len(_TEXTS)) + " ".join(
    "WHEN {} THEN {}".format(i, sql_text(x.replace("{many}", "{k}" + _MANY)).replace("{k}", "' || json_extract_string(props, '$.k') || '"))
    for i, x in enumerate(_TEXTS)
) + " END"


_INJ = "CASE " + " ".join(f"WHEN regexp_matches(query, {sql_text(x)}, 'i') THEN {sql_text(x)}" for x in p.INJECTION_PATTERNS) + " END"
_VERB = "CASE " + " ".join(f"WHEN regexp_matches(upper(query), '\\b{v}\\b') THEN '{v}'" for v in p.FORBIDDEN_VERBS) + " END"
_SCHEMA = "CASE " + " ".join(f"WHEN contains(lower(query), '{s}.') THEN '{s}'" for s in p.FORBIDDEN_SCHEMAS) + " END"
_LIMIT = "TRY_CAST(nullif(regexp_extract(upper(query), 'LIMIT\\s+(\\d+)', 1), '') AS HUGEINT)"
VALIDATED = f"""WITH log AS (SELECT event_id AS query_id, user_id, event_type, ts AS timestamp, {_LOG_SQL} AS query FROM events),
  facts AS (SELECT *, {_INJ} AS inj, {_VERB} AS verb, {_SCHEMA} AS sch, {_LIMIT} AS lim, ltrim(upper(query)) AS start,
    {has('lower(query)', p.ALLOWED_TABLES)} AS allowed FROM log),
  judged AS (SELECT query_id, event_type, timestamp, query, CASE
      WHEN length(query) > 5000 THEN ['QUERY_TOO_LONG', 'medium', 'Query muito longa (' || length(query) || ' caracteres). Máximo: 5000']
      WHEN inj IS NOT NULL THEN ['SQL_INJECTION', 'critical', 'Padrão de SQL injection detectado: ' || inj]
      WHEN verb IS NOT NULL THEN ['FORBIDDEN_COMMAND', 'critical', 'Comando proibido detectado: ' || verb]
      WHEN starts_with(start, 'WITH') AND NOT contains(start, 'SELECT') THEN ['NON_SELECT_QUERY', 'high', 'CTE sem SELECT final']
      WHEN NOT starts_with(start, 'SELECT') AND NOT starts_with(start, 'WITH') THEN ['NON_SELECT_QUERY', 'high', 'Apenas queries SELECT ou CTE (WITH) são permitidas']
      WHEN NOT allowed THEN ['UNAUTHORIZED_TABLE', 'high', 'Query não referencia tabelas Gold permitidas']
      WHEN sch IS NOT NULL THEN ['UNAUTHORIZED_TABLE', 'high', 'Acesso a schema não permitido: ' || sch]
      WHEN NOT contains(upper(query), 'LIMIT') AND NOT contains(upper(query), 'TOP') THEN ['MISSING_LIMIT', 'medium', 'Query deve incluir cláusula LIMIT ou TOP']
      WHEN lim > 10000 THEN ['MISSING_LIMIT', 'medium', 'LIMIT muito alto (' || lim || '). Máximo: 10000'] END AS v FROM facts),
  verdicts AS (SELECT query_id, event_type, timestamp, query, v IS NULL AS valida, v[1] AS violation_type, v[2] AS severity, v[3] AS message FROM judged)"""
_WHEN = "strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp"


@query("r22_validate_sql", f"{VALIDATED} SELECT query_id, event_type, {_WHEN}, query, valida, violation_type, severity, message FROM verdicts")
def r22(spark, d):
    return guard.validate_sql(_query_log(spark, d).drop("user_id"))


def _rated(spark, d):
    log = _query_log(spark, d)
    verdicts = usage.rate_limit(log.select("query_id", "user_id", "timestamp"), "user_id", "timestamp", "query_id", 1, 1)
    return guard.validate_sql(log.join(verdicts, ["user_id", "query_id"]), rate_verdict="veredito")


@query(
    "r22_validate_sql_rated",
    f"""{VALIDATED.replace('WITH log', 'WITH RECURSIVE log')}, numbered AS (
      SELECT user_id, query_id, epoch_us(timestamp) AS t_us, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, query_id) AS rn FROM log),
    replay AS (
      SELECT user_id, query_id, rn, [t_us] AS admitted, true AS ok FROM numbered WHERE rn = 1
      UNION ALL
      SELECT user_id, query_id, rn, CASE WHEN v THEN list_append(recent, t_us) ELSE recent END, v FROM (
        SELECT *, len(list_filter(recent, lambda x: x > t_us - 60000000)) < 1 AND len(recent) < 1 AS v
        FROM (SELECT n.user_id, n.query_id, n.rn, n.t_us, list_filter(r.admitted, lambda x: x > n.t_us - 3600000000) AS recent
          FROM replay r JOIN numbered n ON n.user_id = r.user_id AND n.rn = r.rn + 1)))
    SELECT query_id, valida AND ok AS valida, CASE WHEN NOT valida THEN violation_type WHEN NOT ok THEN 'RATE_LIMIT_EXCEEDED' END AS violation_type,
      CASE WHEN NOT valida THEN severity WHEN NOT ok THEN 'high' END AS severity FROM verdicts JOIN replay USING (query_id)""",
)
def r22_rated(spark, d):
    return _rated(spark, d).select("query_id", "valida", "violation_type", "severity")


@query(
    "a44_violation_summary",
    f"{VALIDATED} SELECT violation_type, severity, count(*) AS total, count(*) AS bloqueadas FROM verdicts WHERE NOT valida GROUP BY 1, 2",
)
def a44(spark, d):
    return audit.violation_summary(guard.violations(guard.validate_sql(_query_log(spark, d).drop("user_id"))))


_VIOLATION = f"query_id, event_type, {_WHEN}, substr(query, 1, 200) AS query, violation_type, severity, message, true AS blocked"


@query("a44_recent_violations", f"{VALIDATED} SELECT {_VIOLATION} FROM verdicts v WHERE NOT valida ORDER BY v.timestamp DESC, query_id DESC LIMIT 10")
def a44_recent(spark, d):
    return audit.recent_violations(guard.violations(guard.validate_sql(_query_log(spark, d).drop("user_id"))))


@query("a44_critical_violations", f"{VALIDATED} SELECT {_VIOLATION} FROM verdicts v WHERE NOT valida AND severity = 'critical'")
def a44_critical(spark, d):
    return audit.critical_violations(guard.violations(guard.validate_sql(_query_log(spark, d).drop("user_id"))))


@query("a44_drop_old_violations", f"{VALIDATED} SELECT {_VIOLATION} FROM verdicts v WHERE NOT valida AND v.timestamp > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def a44_drop_old(spark, d):
    return audit.drop_old_violations(guard.violations(guard.validate_sql(_query_log(spark, d).drop("user_id"))), "2024-01-31", 7)


_DANGER = any_sql(f"regexp_matches(text, {sql_text(x)}, 'i')" for x in p.DANGEROUS_INPUT)
_SPECIAL = f"len(regexp_extract_all(text, {sql_text(p.SPECIAL_CHARACTERS)})) > 5"
_PROBLEM = f"CASE WHEN {_DANGER} THEN 'Padrão suspeito detectado no input' WHEN {_SPECIAL} THEN 'Muitos caracteres especiais no input' END"


@query("r23_validate_input", f"SELECT conv_id, turn, {_PROBLEM} AS problema, {_PROBLEM} IS NULL AS valida FROM conversations")
def r23(spark, d):
    return guard.validate_input(table(spark, d, "conversations")).drop("role", "text")


@query("r23_validate_input_documents", f"SELECT doc_id, {_PROBLEM} AS problema, {_PROBLEM} IS NULL AS valida FROM documents")
def r23_documents(spark, d):
    return guard.validate_input(table(spark, d, "documents").select("doc_id", "text")).drop("text")


PII = [(r"[a-z0-9.]+@[a-z0-9.]+", "EMAIL"), (r"[0-9]{3}-[0-9]{3,4}", "TELEFONE"), (r"[A-Z][a-z]+ [A-Z][a-z]+", "NOME"), (r"[0-9]{4,}", "NUMERO")]


def _redacted_sql(patterns=PII, source="SELECT doc_id, text FROM documents") -> str:
    for i, (pattern, kind) in enumerate(patterns):
        counts = "".join(f", text_pii_{k.lower()}" for _, k in patterns[:i])
        source = (
            f"SELECT doc_id, regexp_replace(text, {sql_text(pattern)}, '[REDACTED]_{kind}', 'g') AS text{counts}, "
            f"CAST(len(regexp_extract_all(text, {sql_text(pattern)})) AS INTEGER) AS text_pii_{kind.lower()} FROM ({source})"
        )
    return source


@query("r20_redact_pii", _redacted_sql())
def r20(spark, d):
    return guard.redact_pii(table(spark, d, "documents").select("doc_id", "text"), ["text"], PII, counts=True)


def _personal(kind: str) -> str:
    """A sentence with each kind of personal data, cut from the digits of an order key; both engines read it."""
    digits = f"lpad(CAST(o_orderkey * 7919 + 13 AS {kind}), 14, '5')"

    def cut(start: int, length: int) -> str:
        return f"substr({digits}, {start}, {length})"

    parts = [
        "'Paciente Ana Silva, CPF '", cut(1, 3), "'.'", cut(4, 3), "'.'", cut(7, 3), "'-'", cut(10, 2), "', '", cut(1, 11),
        "', CNPJ '", cut(1, 2), "'.'", cut(3, 3), "'.'", cut(6, 3), "'/'", cut(9, 4), "'-'", cut(13, 2),
        "', fone('", cut(2, 2), "') 9'", cut(1, 4), "'-'", cut(5, 4), "', nascido 05/06/'", cut(4, 4), "', CEP '", cut(1, 5), "'-'", cut(6, 3),
    ]
    return " || ".join(parts)


@query("r20_redact_pii_fixed_patterns", _redacted_sql(p.PII_PATTERNS, f"SELECT o_orderkey AS doc_id, {_personal('VARCHAR')} AS text FROM orders"))
def r20_fixed(spark, d):
    """The patterns a user gets by default, over sentences with each kind, made from order keys."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_personal('STRING')).alias("text"))
    return guard.redact_pii(rows, ["text"], counts=True)


@query("r20_redact_documents_fixed_patterns", _redacted_sql(p.PII_PATTERNS[:4] + p.PII_PATTERNS[5:]))
def r20_documents(spark, d):
    """The same over whole documents, but for names: the engines differ in what bounds a word of accented letters."""
    patterns = p.PII_PATTERNS[:4] + p.PII_PATTERNS[5:]
    return guard.redact_pii(table(spark, d, "documents").select("doc_id", "text"), ["text"], patterns, counts=True)


@query(
    "r21_drop_pii_columns",
    f"""{SILVER} SELECT ano_mes, sg_uf, nu_idade_n, 'nu_notific' AS nome FROM silver""",
)
def r21(spark, d):
    cases = silver_of(spark, d).select("nu_notific", "ano_mes", "sg_uf", "nu_idade_n", F.lit("select NU_NOTIFIC from x").alias("q"))
    return guard.drop_pii_columns(cases).withColumn("nome", F.array_join(guard.pii_mentions("q"), ",")).drop("q")


@query(
    "r21_pii_mentions",
    f"""{VALIDATED} SELECT query_id, CASE WHEN contains(lower(query), 'ano_mes') THEN '["ano_mes"]' ELSE '[]' END AS nomes FROM log""",
)
def r21_mentions(spark, d):
    return _query_log(spark, d).select("query_id", guard.pii_mentions("query", ["ano_mes", "nu_cpf"]).alias("nomes"))


# --- sources and articles -------------------------------------------------------------------

TRUST = {"official": ["example.org"], "mainstream": ["example.com"], "specialized": ["m.", "example.net"]}
NAMES = {"www.": "Rede", "m.": "Móvel"}
KEYWORDS = ["the", "que", "der", "tion", "heit", "eau"]
NOISE = ["###"]


def _trust_sql(url: str) -> str:
    return "CASE " + " ".join(
        f"WHEN contains(lower({url}), '{dom}') THEN '{level}'" for level, ds in TRUST.items() for dom in ds
    ) + " ELSE 'other' END"


def _name_sql(url: str) -> str:
    cases = " ".join(f"WHEN contains(lower({url}), '{dom}') THEN '{name}'" for dom, name in NAMES.items())
    return f"CASE {cases} ELSE split_part(split_part({url}, '//', -1), '/', 1) END"


@query("x5_url_host", "SELECT page_id, split_part(split_part(url, '//', -1), '/', 1) AS host FROM pages")
def x5(spark, d):
    return table(spark, d, "pages").select("page_id", tx.url_host("url").alias("host"))


@query("r24_source_trust", f"SELECT page_id, url, {_trust_sql('url')} AS source_trust, {_name_sql('url')} AS source FROM pages")
def r24(spark, d):
    return table(spark, d, "pages").select(
        "page_id", "url", tx.source_trust("url", TRUST).alias("source_trust"), tx.source_name("url", NAMES).alias("source")
    )


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_BODY = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
_UF_LIST = "[" + ", ".join(f"'{s}'" for s in STATE_CODES) + "]"
_UFS = f"list_sort(list_distinct(list_filter(regexp_split_to_array(upper({{0}}), '[^\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda w: list_contains({_UF_LIST}, w))))"


def _ufs(col: str) -> str:
    return _UFS.format(col)


def _pct_list(col: str) -> str:
    return f"regexp_extract_all({col}, '\\b\\d+(?:,\\d+)?%')"


ARTICLES = f"""WITH hits AS (SELECT page_id, url, {_TITLE} AS title, {_BODY} AS content FROM pages),
  articles AS (SELECT page_id, title, url, substr(content, 1, 300) AS snippet, 'N/A' AS published_date, {_name_sql('url')} AS source,
    {_trust_sql('url')} AS source_trust, list_concat({_ufs("title || ' ' || content")}, {_pct_list("title || ' ' || content")}) AS entities,
    md5(lower(title || substr(content, 1, 300))) AS hash FROM hits)"""


def _articles(spark, d):
    hits = table(spark, d, "pages").select(
        "page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_replace("html", "<[^>]*>", " ").alias("content"),
    )
    return tx.parse_results(hits, "title", "url", "content", F.lit(None).cast("string"), ["page_id"], TRUST, NAMES)


@query(
    "r28_parse_results",
    f"{ARTICLES} SELECT page_id, title, url, snippet, published_date, source, source_trust, {_JSON_LIST.format('entities')} AS entities, hash FROM articles",
)
def r28(spark, d):
    return _articles(spark, d)


_LOW = "lower(title || ' ' || snippet)"
_HITS = " + ".join(f"contains({_LOW}, '{w}')::INT" for w in KEYWORDS)
SCORED = f"""{ARTICLES}, scored AS (SELECT page_id, source, source_trust, hash, round(least(({_HITS}) / {len(KEYWORDS)}.0::DOUBLE, 1) * 0.4::DOUBLE
  + CASE source_trust WHEN 'official' THEN 0.3::DOUBLE WHEN 'mainstream' THEN 0.25::DOUBLE WHEN 'specialized' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END
  + 0.1::DOUBLE + CASE WHEN {has(_LOW, NOISE)} THEN 0 ELSE 0.1::DOUBLE END, 3) AS relevance_score FROM articles),
  banded AS (SELECT *, CASE WHEN relevance_score >= 0.7 THEN 'high' WHEN relevance_score >= 0.5 THEN 'medium' ELSE 'low' END AS relevance FROM scored)"""


def _scored(spark, d):
    return tx.score_articles(_articles(spark, d), KEYWORDS, NOISE)


@query("r27_relevance", f"{SCORED} SELECT * FROM banded WHERE relevance_score >= 0.5")
def r27(spark, d):
    return tx.relevant_articles(_scored(spark, d)).select("page_id", "source", "source_trust", "hash", "relevance_score", "relevance")


@query(
    "a43_relevance_counts",
    f"""{SCORED} SELECT source, count(*) FILTER (WHERE relevance = 'high') AS high, count(*) FILTER (WHERE relevance = 'medium') AS medium,
    count(*) FILTER (WHERE relevance = 'low') AS low, count(*) AS total FROM banded GROUP BY source""",
)
def a43(spark, d):
    return tx.relevance_counts(_scored(spark, d))


@query(
    "r25_extract_entities",
    f"""SELECT doc_id, {_JSON_LIST.format(f"list_concat({_ufs('text')}, {_pct_list('text')})")} AS entidades,
    {_JSON_LIST.format(f"regexp_extract_all(text, {sql_text(p.NUMBER_PATTERN)}, 0, 'i')")} AS numeros FROM documents""",
)
def r25(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.entities("text").alias("entidades"), F.to_json(tx.numbers("text")).alias("numeros")
    )


@query("x4_content_hash", "SELECT doc_id, md5(lower(source || text)) AS hash FROM documents")
def x4(spark, d):
    return table(spark, d, "documents").select("doc_id", content_hash("source", "text").alias("hash"))


@query(
    "x2_clean_and_truncate",
    """SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), ' ') AS limpo,
    CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 240) || ' ... [TRUNCADO ' || length(text) || ' chars] ... ' || right(text, 240) END AS curto
    FROM documents""",
)
def x2(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_\s-]", "")).alias("limpo"),
        head_and_tail("text").alias("curto"),
    )


@query("r26_dedupe_articles", "SELECT doc_id, source, md5(lower(text)) AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY doc_id) = 1")
def r26(spark, d):
    return tx.dedupe_by_content(table(spark, d, "documents").select("doc_id", "source", "text"), ["text"], ["doc_id"]).drop("text")


@query("r26_dedupe_report", "SELECT count(*) AS total, count(DISTINCT md5(lower(text))) AS mantidos, count(*) - count(DISTINCT md5(lower(text))) AS removidos FROM documents")
def r26_report(spark, d):
    return tx.dedupe_report(table(spark, d, "documents"), ["text"])


# --- documents ------------------------------------------------------------------------------


def _fill_sql(template: str, fields: dict[str, str]) -> str:
    return " || ".join(sql_text(x) if kind == "text" else fields[x] for kind, x in t.pieces(template))


def _fixed_sql(c: str, signed: bool = False) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE printf('%{'+' if signed else ''}.2f', {c}) END"


_N = "format('{:,}', total_casos)"
_MONTH_DOC = _fill_sql(t.MONTH_TEMPLATE, {
    "ano_mes": "ano_mes", "total_casos": _N, "taxa_crescimento": _fixed_sql("taxa_crescimento", True),
    **{c: _fixed_sql(c) for c in ("taxa_mortalidade", "taxa_uti", "taxa_vacinacao")},
})
_STATE_DOC = _fill_sql(t.STATE_TEMPLATE, {
    "sg_uf": "sg_uf", "total_casos": _N, "ranking_casos": "CAST(ranking_casos AS VARCHAR)",
    **{c: _fixed_sql(c) for c in ("taxa_mortalidade", "taxa_uti", "taxa_vacinacao", "percentual_nacional")},
})
_AGE_DOC = _fill_sql(t.AGE_SEX_TEMPLATE, {
    "faixa_etaria": "faixa_etaria", "sexo_label": "sexo_label", "total_casos": _N,
    **{c: _fixed_sql(c) for c in ("taxa_mortalidade", "taxa_internacao", "percentual_total")},
})
_KPI_DOC = _fill_sql(t.KPI_TEMPLATE, {
    **{c: c for c in ("categoria", "metrica", "unidade", "descricao", "escopo")}, "valor": "CAST(valor AS VARCHAR)", "data_snapshot": "'2024-01-01'",
})
DOCUMENTS = f"""{SILVER}, {KPIS}, {KPI_LONG}, {MONTHLY}, {STATES}, {AGE_SEX}, docs AS (
  SELECT 'resumo_' || categoria || '_' || metrica || '_2024-01-01' AS doc_id, 'gold_resumo_geral' AS source_table, 'metric' AS semantic_type, {_KPI_DOC} AS content FROM kpi_long
  UNION ALL SELECT 'temporal_' || ano_mes, 'gold_metricas_temporais', 'temporal', {_MONTH_DOC} FROM (SELECT * FROM monthly_metrics ORDER BY ano_mes DESC LIMIT 24)
  UNION ALL SELECT 'geo_' || sg_uf, 'gold_metricas_geograficas', 'geographic', {_STATE_DOC} FROM state_profile
  UNION ALL SELECT 'demo_' || faixa_etaria || '_' || sexo_label, 'gold_metricas_demograficas', 'demographic', {_AGE_DOC} FROM age_sex)"""


def _gold_documents(spark, d):
    silver = written_silver(spark, d)
    kpis = gold.kpi_rows(gold.national_kpis(silver)).withColumn("data_snapshot", F.to_date(F.lit("2024-01-01")))
    return docs.all_documents(kpis, gold.monthly_metrics(silver, key_is_unique=True), gold.state_profile(silver, key_is_unique=True), gold.age_sex_profile(silver))


@query("r1_render_documents", f"{DOCUMENTS} SELECT * FROM docs")
def r1(spark, d):
    return _gold_documents(spark, d).drop("metadata")


@query(
    "r1_document_metadata",
    f"""{SILVER}, {STATES} SELECT 'geo_' || sg_uf AS doc_id, sg_uf AS uf, CAST(total_casos AS VARCHAR) AS total_casos,
    CAST(ranking_casos AS VARCHAR) AS ranking, 'geographic_profile' AS tipo FROM state_profile""",
)
def r1_metadata(spark, d):
    found = docs.state_documents(gold.state_profile(silver_of(spark, d), key_is_unique=True))
    return found.select("doc_id", *[F.col("metadata")[k].alias(k) for k in ("uf", "total_casos", "ranking", "tipo")])


_STATS = """count(*) AS documentos, CAST(sum(length(content)) AS BIGINT) AS caracteres, round(sum(length(content)) / count(*), 2) AS media_caracteres,
  CAST(sum(count(*)) OVER () AS BIGINT) AS total_documentos, CAST(sum(sum(length(content))) OVER () AS BIGINT) AS total_caracteres,
  round(sum(sum(length(content))) OVER () / sum(count(*)) OVER (), 2) AS media_geral"""


@query("r2_load_all_statistics", f"{DOCUMENTS} SELECT semantic_type, {_STATS} FROM docs GROUP BY semantic_type")
def r2(spark, d):
    return docs.document_statistics(_gold_documents(spark, d))


@query("a42_document_statistics", f"SELECT lang, {_STATS} FROM (SELECT lang, text AS content FROM documents) GROUP BY lang")
def a42(spark, d):
    return docs.document_statistics(table(spark, d, "documents"), "lang", "text")


@query(
    "r3_validate_documents",
    """WITH d AS (SELECT CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS doc_id,
      lang, regexp_replace(CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE '  ' || text || chr(10) END, '^\\s+|\\s+$', '', 'g') AS content FROM documents)
    SELECT coalesce(nullif(doc_id, ''), 'auto_' || md5(lower(content))) AS doc_id, lang, content FROM d WHERE content <> ''""",
)
def r3(spark, d):
    i = F.col("doc_id")
    raw = table(spark, d, "documents").select(
        F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, "").otherwise(i.cast("string")).alias("doc_id"), "lang",
        F.when(i % 7 == 0, "  ").otherwise(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("content"),
    )
    return docs.validate_documents(raw)


def _with_vectors(spark, d):
    """Documents beside the vector of the same number, where there is one."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return table(spark, d, "documents").join(vectors, "doc_id", "left")


@query(
    "r4_embedding_rows",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content, embedding IS NULL AS sem_vetor, 'unknown' AS source_table, 'general' AS semantic_type,
    'geral' AS categoria, 'indefinida' AS metrica, CASE WHEN lang = 'en' THEN source ELSE 'BR' END AS uf, '2024-01' AS ano_mes, 'todas' AS faixa_etaria,
    CASE WHEN lang = 'en' THEN '{"uf":"' || source || '"}' ELSE '{"lang":"' || lang || '"}' END AS metadata_json
    FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
)
def r4(spark, d):
    meta = F.when(F.col("lang") == "en", F.create_map(F.lit("uf"), "source")).otherwise(F.create_map(F.lit("lang"), "lang"))
    rows = docs.embedding_rows(_with_vectors(spark, d).withColumns({"content": F.col("text"), "metadata": meta}).drop("lang", "source"))
    return rows.withColumn("sem_vetor", F.col("embedding").isNull()).drop("embedding", "created_at")


@query("r5_check_dims", "SELECT doc_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE embedding IS NULL OR len(embedding) <> 64")
def r5(spark, d):
    return docs.wrong_dimensions(_with_vectors(spark, d), 64).select("doc_id")


@query("r6_fill_missing_vectors", "SELECT doc_id, embedding IS NULL AS sem_vetor, 64 AS dim, embedding IS NULL AS zero FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def r6(spark, d):
    filled = docs.fill_missing_vectors(_with_vectors(spark, d), 64)
    return filled.select("doc_id", "sem_vetor", F.size("embedding").alias("dim"), (~F.exists("embedding", lambda x: x != 0)).alias("zero"))


# --- search ---------------------------------------------------------------------------------

CENTROIDS = """centroids AS (SELECT label AS query_id, list(x ORDER BY pos) AS vector FROM (
    SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""
CORPUS = """corpus AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS embedding, text AS content, label,
    CASE label % 3 WHEN 0 THEN 'geographic' WHEN 1 THEN 'temporal' ELSE 'metric' END AS semantic_type,
    CASE WHEN vec_id % 2 = 0 THEN 'gold_resumo_geral' ELSE 'gold_series_temporais' END AS source_table,
    source AS uf, CAST(2023 + vec_id % 4 AS VARCHAR) || '-0' || (1 + vec_id % 9) AS ano_mes
  FROM embeddings JOIN documents ON vec_id = doc_id)"""
SCORES = """scores AS (SELECT query_id, doc_id AS id, semantic_type, source_table, uf, ano_mes, content, round(list_cosine_similarity(q.vector, c.embedding), 10) AS score
  FROM centroids q JOIN corpus c ON true)"""
RANKED = "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scores)"


def _corpus(spark, d):
    i, kind = F.col("doc_id"), F.col("label") % 3
    return _with_vectors(spark, d).filter(F.col("embedding").isNotNull()).select(
        "doc_id", "embedding", F.col("text").alias("content"), "label",
        F.when(kind == 0, "geographic").when(kind == 1, "temporal").otherwise("metric").alias("semantic_type"),
        F.when(i % 2 == 0, "gold_resumo_geral").otherwise("gold_series_temporais").alias("source_table"),
        F.col("source").alias("uf"),
        F.concat((i % 4 + 2023).cast("string"), F.lit("-0"), (i % 9 + 1).cast("string")).alias("ano_mes"),
    )


def _queries(spark, d):
    return search.centroids(table(spark, d, "embeddings"), "label")


@query("r7_knn", f"WITH {CENTROIDS}, {CORPUS}, {SCORES}, {RANKED} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5")
def r7(spark, d):
    found = search.knn(_queries(spark, d), _corpus(spark, d), 5)
    return found.withColumn("score", F.round("score", 6))


@query(
    "r7_knn_all_documents",
    f"""WITH {CORPUS}, scores AS (SELECT q.vec_id AS query_id, c.doc_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding), 10) AS score
      FROM embeddings q JOIN corpus c ON true), {RANKED} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 3""",
)
def r7_blocks(spark, d):
    """Every vector as a query: more than travel with the tasks when `max_carried` says so."""
    asked = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = search.knn(asked, _corpus(spark, d), 3, max_carried=64)
    return found.withColumn("score", F.round("score", 6))


@query("r7_cells_read")
def r7_read(spark, d):
    """What the search of all rows against all reads of the index: depends on the cells, so SQL has no twin."""
    corpus = _corpus(spark, d)
    asked = corpus.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = cells.build_cells(corpus, corpus.agg(F.max(F.size("embedding"))).first()[0] or 0)
    reads = cells.cells_read(asked, index, 3)
    total = index.cells.agg(F.count("*").alias("cells"), F.sum("rows").alias("rows")).first()
    return reads.withColumns({"all_cells": F.lit(total["cells"]), "all_rows": F.lit(total["rows"])})


@query(
    "r8_knn_filtered",
    f"""WITH {CENTROIDS}, {CORPUS.replace('ON vec_id = doc_id', "ON vec_id = doc_id WHERE label % 3 = 1 AND vec_id % 2 = 0")}, {SCORES}, {RANKED}
    SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5""",
)
def r8(spark, d):
    filters = {"semantic_type": "temporal", "source_table": "gold_resumo_geral", "label": "7"}
    found = search.knn(_queries(spark, d), _corpus(spark, d), 5, filters=filters)
    return found.withColumn("score", F.round("score", 6))


@query(
    "r9_hybrid",
    f"""WITH {CENTROIDS}, {CORPUS}, {SCORES}, {RANKED}, boosted AS (SELECT query_id, id, score, round(score
      * CASE WHEN source_table = 'gold_resumo_geral' THEN 1.2::DOUBLE ELSE 1 END
      * CASE WHEN contains(ano_mes, '2024') OR contains(ano_mes, '2025') THEN 1.1::DOUBLE ELSE 1 END
      * CASE WHEN contains('casos em src' || query_id || ' no mês 2024-0' || query_id, lower(uf)) THEN 1.15::DOUBLE ELSE 1 END
      * CASE WHEN contains('casos em src' || query_id || ' no mês 2024-0' || query_id, ano_mes) THEN 1.1::DOUBLE ELSE 1 END, 10) AS final_score
      FROM ranked WHERE rank <= 10)
    SELECT query_id, id, round(score, 6) AS score, round(final_score, 6) AS final_score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS INTEGER) AS rank FROM boosted) WHERE rank <= 5""",
)
def r9(spark, d):
    q = F.col("query_id").cast("string")
    asked = _queries(spark, d).withColumn("text", F.concat(F.lit("casos em src"), q, F.lit(" no mês 2024-0"), q))
    found = search.hybrid(asked, _corpus(spark, d), 5)
    return found.withColumns({"score": F.round("score", 6), "final_score": F.round("final_score", 6)})


GEO_WORDS, TIME_WORDS = ["le", "ein", "sh"], ["the", "que"]


@query(
    "r10_typed",
    f"""WITH {CORPUS}, asked AS (SELECT conv_id AS query_id, embedding::DOUBLE[] AS vector,
      CASE WHEN {hit('lower(text)', whole(*GEO_WORDS), 'c')} THEN 'geographic' WHEN {hit('lower(text)', whole(*TIME_WORDS), 'c')} THEN 'temporal' END AS kind
      FROM (SELECT conv_id * 1000 + turn AS conv_id, conv_id AS vec, text FROM conversations WHERE role = 'user') JOIN embeddings ON vec_id = vec),
    scores AS (SELECT query_id, doc_id AS id, kind, round(list_cosine_similarity(q.vector, c.embedding), 10) AS score
      FROM asked q JOIN corpus c ON q.kind IS NULL OR c.semantic_type = q.kind), {RANKED}
    SELECT query_id, id, round(score, 6) AS score, rank, kind AS semantic_type FROM ranked WHERE rank <= 3""",
)
def r10(spark, d):
    said = table(spark, d, "conversations").filter(F.col("role") == "user")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("vector"))
    kind = search.question_document_type("text", states=(), geographic=GEO_WORDS, temporal=TIME_WORDS)
    said = said.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), kind.alias("kind"))
    found = search.typed(said.join(vectors, "conv_id"), _corpus(spark, d), 3, wanted="kind")
    return found.withColumn("score", F.round("score", 6))


_PART = """'**DOCUMENTO ' || rank || ':**' || chr(10) || 'Fonte: ' || source_table || chr(10) || 'Tipo: ' || semantic_type || chr(10)
  || 'Período: ' || ano_mes || chr(10) || 'Estado: ' || uf || chr(10) || chr(10) || content || chr(10) || chr(10) || '---' || chr(10) || chr(10)"""


def _found_documents(spark, d, k):
    corpus = _corpus(spark, d)
    found = search.knn(_queries(spark, d), corpus, k)
    return found.join(corpus.withColumnRenamed("doc_id", "id").drop("embedding"), "id").withColumn("doc_id", F.col("id"))


@query(
    "r11_build_context",
    f"""WITH {CENTROIDS}, {CORPUS}, {SCORES}, {RANKED}, parts AS (SELECT query_id, rank, {_PART} AS part FROM ranked WHERE rank <= 15),
    run AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM parts)
    SELECT query_id, count(*) FILTER (WHERE so_far <= 8000) AS documentos,
      coalesce(string_agg(part, '' ORDER BY rank) FILTER (WHERE so_far <= 8000), '') AS contexto FROM run GROUP BY query_id""",
)
def r11(spark, d):
    return docs.build_context(_found_documents(spark, d, 15), "query_id")


@query(
    "r12_context_with_citations",
    f"""WITH {CENTROIDS}, {CORPUS}, {SCORES}, {RANKED}, parts AS (SELECT *, '[' || rank || '] ' || content || chr(10) || chr(10) AS part FROM ranked WHERE rank <= 15),
    run AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM parts)
    SELECT query_id, coalesce(string_agg(part, '' ORDER BY rank) FILTER (WHERE so_far <= 4000), '') AS contexto,
      string_agg('[' || rank || ']=' || '{{"source_table":"' || source_table || '","semantic_type":"' || semantic_type || '","doc_id":"' || id || '"}}', ';' ORDER BY rank)
        FILTER (WHERE so_far - length(part) <= 4000) AS citacoes FROM run GROUP BY query_id""",
)
def r12(spark, d):
    out = docs.context_with_citations(_found_documents(spark, d, 15), "query_id", max_length=4000)
    cited = F.transform(F.map_entries("citacoes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.withColumn("citacoes", F.array_join(cited, ";"))


@query("x11_array_math", "SELECT vec_id, len(embedding) AS n, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS quadrado FROM embeddings")
def x11(spark, d):
    v = F.col("embedding").cast("array<double>")
    square = F.aggregate(F.zip_with(v, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.round(square, 6).alias("quadrado"))
