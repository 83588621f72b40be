"""Rules over tables of SQL texts and user inputs, and redaction of personal data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episurv.functions import patterns as p
from episurv.functions.columns import as_col
from episurv.operators.textrules import contains_any, first_of, labels_where, matches_any


def _verdict(kind: str, severity: str, message: Column | str) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(kind).alias("violation_type"), F.lit(severity).alias("severity"), text.alias("message"))


def _named(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), name)


def sql_violation(
    query: str | Column,
    rate_verdict: str | Column | None = None,
    max_length: int = p.MAX_QUERY_LENGTH,
    max_limit: int = p.MAX_LIMIT,
    tables: Sequence[str] = tuple(p.ALLOWED_TABLES),
    schemas: Sequence[str] = tuple(p.FORBIDDEN_SCHEMAS),
) -> Column:
    """First rule a query text breaks as (type, severity, message); NULL for a valid text.

    The rate rule comes last and needs the verdict of the limiter beside the text.
    """
    text = as_col(query)
    upper, low = F.upper(text), F.lower(text)
    injected = first_of([(text.rlike(p.FLAGS_ANY_CASE + x), x) for x in p.INJECTION_PATTERNS], None)
    verb = first_of([(upper.rlike(rf"{p.FLAGS}\b{v}\b"), v) for v in p.FORBIDDEN_VERBS], None)
    start = F.trim(F.regexp_replace(upper, r"(?U)^\s+", ""))
    with_select = start.startswith("WITH") & start.contains("SELECT")
    schema = first_of([(low.contains(f"{s}."), s) for s in schemas], None)
    digits = F.regexp_extract(upper, r"(?U)LIMIT\s+(\d+)", 1)
    limit = digits.try_cast("decimal(38,0)")
    too_high = (digits != "") & (limit.isNull() | (limit > max_limit))
    rules = [
        (
            F.length(text) > max_length,
            _verdict(
                "QUERY_TOO_LONG", "medium",
                F.concat(F.lit("Query muito longa ("), F.length(text).cast("string"), F.lit(f" caracteres). Máximo: {max_length}")),
            ),
        ),
        (injected.isNotNull(), _verdict("SQL_INJECTION", "critical", _named("Padrão de SQL injection detectado: ", injected))),
        (verb.isNotNull(), _verdict("FORBIDDEN_COMMAND", "critical", _named("Comando proibido detectado: ", verb))),
        (
            start.startswith("WITH") & ~start.contains("SELECT"),
            _verdict("NON_SELECT_QUERY", "high", "CTE sem SELECT final"),
        ),
        (
            ~(start.startswith("SELECT") | with_select),
            _verdict("NON_SELECT_QUERY", "high", "Apenas queries SELECT ou CTE (WITH) são permitidas"),
        ),
        (~contains_any(low, tables), _verdict("UNAUTHORIZED_TABLE", "high", "Query não referencia tabelas Gold permitidas")),
        (schema.isNotNull(), _verdict("UNAUTHORIZED_TABLE", "high", _named("Acesso a schema não permitido: ", schema))),
        (
            ~(upper.contains("LIMIT") | upper.contains("TOP")),
            _verdict("MISSING_LIMIT", "medium", "Query deve incluir cláusula LIMIT ou TOP"),
        ),
        (
            too_high,
            _verdict("MISSING_LIMIT", "medium", F.concat(F.lit("LIMIT muito alto ("), digits, F.lit(f"). Máximo: {max_limit}"))),
        ),
    ]
    if rate_verdict is not None:
        rules.append(
            (as_col(rate_verdict) != "permitido", _verdict("RATE_LIMIT_EXCEEDED", "high", "Limite de queries excedido"))
        )
    out = F.lit(None)
    for broken, verdict in reversed(rules):
        out = F.when(broken, verdict).otherwise(out)
    return out


def validate_sql(df: DataFrame, query: str = "query", rate_verdict: str | None = None) -> DataFrame:
    """Every query text with its verdict, type, severity and message."""
    # The generator evaluates the rules once per row, also when a later filter reads the verdict.
    judged = df.select("*", F.inline(F.array(sql_violation(query, rate_verdict))))
    return judged.withColumn("valida", F.col("violation_type").isNull())


def violations(validated: DataFrame, query: str = "query", prefix: int = 200) -> DataFrame:
    """Violation records of a validated query log; the record quotes the head of the text."""
    return validated.filter(~F.col("valida")).withColumns(
        {query: F.substring(query, 1, prefix), "blocked": F.lit(True)}
    ).drop("valida")


def input_problem(text: str | Column, max_special: int = p.MAX_SPECIAL) -> Column:
    """Why a user's free text is refused; NULL when it is fine."""
    c = as_col(text)
    return F.when(matches_any(c, p.DANGEROUS_INPUT), "Padrão suspeito detectado no input").when(
        F.regexp_count(c, F.lit(p.SPECIAL_CHARACTERS)) > max_special, "Muitos caracteres especiais no input"
    )


def validate_input(df: DataFrame, text: str = "text") -> DataFrame:
    problem = input_problem(text)
    return df.withColumns({"problema": problem, "valida": problem.isNull()})


# --- personal data --------------------------------------------------------------------------


def redact_pii(
    df: DataFrame,
    cols: Sequence[str],
    patterns: Sequence[tuple[str, str]] = tuple(p.PII_PATTERNS),
    token: str = p.PII_TOKEN,
    counts: bool = False,
) -> DataFrame:
    """Replace each pattern in turn by the token and its type, in the given text columns.

    With `counts`, `<col>_pii_<type>` tells how many were replaced. Each step is its own
    projection, so a count reads the text as the steps before left it.
    """
    safe = token.replace("\\", "\\\\").replace("$", "\\$")
    out = df
    for c in cols:
        for pattern, kind in patterns:
            step = {c: F.regexp_replace(F.col(c), p.FLAGS + pattern, f"{safe}_{kind}")}
            if counts:
                step[f"{c}_pii_{kind.lower()}"] = F.regexp_count(F.col(c), F.lit(p.FLAGS + pattern))
            out = out.withColumns(step)
    return out


def drop_pii_columns(df: DataFrame, names: Sequence[str] = tuple(p.PII_COLUMNS)) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names])


def pii_mentions(text: str | Column, names: Sequence[str] = tuple(p.PII_COLUMNS)) -> Column:
    """Names of personal-data columns that a text mentions."""
    low = F.lower(as_col(text))
    return labels_where([(n, low.contains(n.lower())) for n in names])


def sanitize(df: DataFrame, patterns: Sequence[tuple[str, str]] = tuple(p.PII_PATTERNS)) -> DataFrame:
    """Drop the personal columns and redact every text column."""
    kept = drop_pii_columns(df)
    texts = [f.name for f in kept.schema.fields if f.dataType.simpleString() == "string"]
    return redact_pii(kept, texts, patterns)
