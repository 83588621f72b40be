"""Rule-based text classification, routing, entities, sources and relevance, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episurv.functions import patterns as p
from episurv.functions.codes import MONTH_NAMES, STATE_CODES
from episurv.functions.columns import any_of, as_col
from episurv.functions.documents import content_hash
from episurv.operators.filters import first_per_key

WORD_SPLIT = r"[^\p{L}\p{N}_]+"


# --- building blocks ------------------------------------------------------------------------


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return any_of(text.contains(w) for w in words)


def matches_any(text: Column, patterns: Sequence[str], flags: str = p.FLAGS_ANY_CASE) -> Column:
    return any_of(text.rlike(flags + pattern) for pattern in patterns)


def labels_where(tests: Sequence[tuple[str, Column]]) -> Column:
    """The labels whose test holds, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in tests]))


def first_of(tests: Sequence[tuple[Column, Column | str]], last: Column | str | None) -> Column:
    """Value of the first test that holds."""
    out = last if isinstance(last, Column) else F.lit(last)
    for test, value in reversed(list(tests)):
        out = F.when(test, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def words(text: str | Column) -> Column:
    return F.filter(F.split(as_col(text), WORD_SPLIT), lambda w: w != "")


# --- questions ------------------------------------------------------------------------------


def classify_intent(
    text: str | Column,
    patterns: Mapping[str, Sequence[str]] = p.INTENT_PATTERNS,
    default: str = p.DEFAULT_INTENT,
) -> Column:
    """Classes whose patterns occur, in class order; the default class when none does."""
    found = labels_where([(label, matches_any(as_col(text), ps)) for label, ps in patterns.items()])
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def choose_strategy(intents: str | Column, strategies: Mapping[str, str] = p.INTENT_STRATEGY) -> Column:
    """Hybrid for several classes, else the strategy of the one class."""
    classes = as_col(intents)
    single = first_of([(classes[0] == label, s) for label, s in strategies.items()], "sql_only")
    return F.when(F.size(classes) > 1, "hybrid").when(F.size(classes) == 0, "sql_only").otherwise(single)


def target_tables(
    text: str | Column,
    intents: str | Column,
    by_intent: Mapping[str, Sequence[str]] = p.INTENT_TABLES,
    by_word: Mapping[str, Sequence[str]] = p.KEYWORD_TABLES,
    default: Sequence[str] = p.DEFAULT_TABLES,
) -> Column:
    """Tables of the classes and of the keywords, sorted."""
    low, classes = F.lower(as_col(text)), as_col(intents)
    known = F.array(*[F.lit(i) for i in by_intent])
    parts = [
        F.when(F.array_contains(classes, i), F.array(*[F.lit(t) for t in ts])) for i, ts in by_intent.items()
    ]
    parts.append(F.when(F.size(F.array_except(classes, known)) > 0, F.array(*[F.lit(t) for t in default])))
    parts += [F.when(contains_any(low, ws), F.array(F.lit(t))) for t, ws in by_word.items()]
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*parts)))))


def state_filter(text: str | Column, states: Sequence[str] = tuple(STATE_CODES)) -> Column:
    """First state code written in capitals."""
    found = F.regexp_extract(as_col(text), rf"{p.FLAGS}\b({'|'.join(states)})\b", 1)
    return F.when(found != "", found)


def month_filter(text: str | Column, months: Sequence[str] = tuple(MONTH_NAMES)) -> Column:
    """`YYYY-MM` of the first listed month that is named, when a year 20xx is given too."""
    low = F.lower(as_col(text))
    number = first_of([(low.contains(m), f"{i:02d}") for i, m in enumerate(months, 1)], None)
    year = F.regexp_extract(as_col(text), rf"{p.FLAGS}\b(20\d{{2}})\b", 1)
    return F.when(number.isNotNull() & (year != ""), F.concat(year, F.lit("-"), number))


def route_confidence(text: str | Column, intents: str | Column, keywords: Sequence[str] = tuple(p.CONFIDENT_WORDS)) -> Column:
    low = F.lower(as_col(text))
    n_words = F.size(F.filter(F.split(low, r"(?U)\s+"), lambda w: w != ""))
    score = (
        F.lit(0.7)
        + F.when(contains_any(low, keywords), 0.2).otherwise(0.0)
        - F.when(n_words < 4, 0.1).otherwise(0.0)
        - F.when(F.size(as_col(intents)) > 2, 0.15).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.5), F.least(F.lit(0.95), score)), 2)


def document_type(intents: str | Column, types: Mapping[str, str] = p.INTENT_DOCUMENT_TYPE) -> Column:
    """Document type of the first class that has one."""
    typed = F.filter(as_col(intents), lambda i: i.isin(*types))
    return F.when(F.size(typed) > 0, first_of([(F.get(typed, F.lit(0)) == i, t) for i, t in types.items()], None))


def route_questions(
    df: DataFrame,
    text: str = "text",
    patterns: Mapping[str, Sequence[str]] = p.INTENT_PATTERNS,
    default: str = p.DEFAULT_INTENT,
    by_word: Mapping[str, Sequence[str]] = p.KEYWORD_TABLES,
    keywords: Sequence[str] = tuple(p.CONFIDENT_WORDS),
    states: Sequence[str] = tuple(STATE_CODES),
    months: Sequence[str] = tuple(MONTH_NAMES),
) -> DataFrame:
    """Classes, strategy, tables, filters, document type and confidence of each question."""
    routed = df.withColumn("intencoes", classify_intent(text, patterns, default)).withColumn(
        "estrategia", choose_strategy("intencoes")
    )
    tabular = F.col("estrategia") != "rag_only"
    return routed.withColumns(
        {
            "intencao": F.when(F.size("intencoes") == 1, F.col("intencoes")[0]).otherwise("mixed"),
            "tabelas": target_tables(text, "intencoes", by_word=by_word),
            "filtro_uf": F.when(tabular, state_filter(text, states)),
            "filtro_ano_mes": F.when(tabular, month_filter(text, months)),
            "tipo_documento": F.when(F.col("estrategia") != "sql_only", document_type("intencoes")),
            "confianca": route_confidence(text, "intencoes", keywords),
        }
    )


def question_types(df: DataFrame, text: str = "text", types: Mapping[str, Sequence[str]] = p.QUESTION_TYPES) -> DataFrame:
    """Keyword classes of a question, the first as primary, and the document type they prefer."""
    low = F.lower(F.col(text))
    found = labels_where([(label, contains_any(low, ws)) for label, ws in types.items()])
    return df.withColumn("tipos", found).withColumns(
        {
            "tipo_principal": F.coalesce(F.get("tipos", F.lit(0)), F.lit("general")),
            "tipo_preferido": F.when(F.array_contains("tipos", "temporal"), "temporal").when(
                F.array_contains("tipos", "geographic"), "geographic"
            ),
            "complexidade": F.when(F.size("tipos") > 1, "complex").otherwise("simple"),
        }
    )


def answer_quality(
    df: DataFrame, answer: str, n_sources: str, phrases: Sequence[str] = tuple(p.GENERIC_PHRASES), min_length: int = 20
) -> DataFrame:
    """Issues of an answer and a score that loses 0.3 per issue."""
    text = F.coalesce(F.col(answer), F.lit(""))
    issues = labels_where(
        [
            (p.ISSUE_SHORT, F.length(text) < min_length),
            (p.ISSUE_NO_SOURCE, F.col(n_sources) == 0),
            (p.ISSUE_GENERIC, contains_any(F.lower(text), phrases) & (F.col(n_sources) > 0)),
        ]
    )
    return df.withColumn("problemas", issues).withColumns(
        {
            "valida": F.size("problemas") == 0,
            "nota": F.round(F.lit(1.0) - F.size("problemas") * F.lit(0.3), 1),
        }
    )


# --- entities -------------------------------------------------------------------------------


def state_mentions(text: str | Column, states: Sequence[str] = tuple(STATE_CODES)) -> Column:
    """Distinct state codes among the words in capitals, sorted."""
    return F.array_sort(F.array_intersect(words(F.upper(as_col(text))), F.array(*[F.lit(s) for s in states])))


def percentages(text: str | Column) -> Column:
    return F.regexp_extract_all(as_col(text), F.lit(p.FLAGS + p.PERCENT_PATTERN), F.lit(0))


def numbers(text: str | Column) -> Column:
    return F.regexp_extract_all(as_col(text), F.lit(p.FLAGS_ANY_CASE + p.NUMBER_PATTERN), F.lit(0))


def entities(text: str | Column, states: Sequence[str] = tuple(STATE_CODES)) -> Column:
    return F.concat(state_mentions(text, states), percentages(text))


# --- sources and articles -------------------------------------------------------------------


def source_trust(
    url: str | Column, trust: Mapping[str, Sequence[str]] = p.SOURCE_TRUST, other: str = p.OTHER_SOURCE
) -> Column:
    """Trust class of the first domain found in the address."""
    low = F.lower(as_col(url))
    return first_of([(low.contains(domain), level) for level, ds in trust.items() for domain in ds], other)


def url_host(url: str | Column) -> Column:
    """What stands between the scheme and the next slash."""
    return F.substring_index(F.substring_index(as_col(url), "//", -1), "/", 1)


def source_name(url: str | Column, names: Mapping[str, str] = p.SOURCE_NAMES) -> Column:
    low = F.lower(as_col(url))
    return first_of([(low.contains(domain), name) for domain, name in names.items()], url_host(url))


def parse_results(
    df: DataFrame,
    title: str | Column,
    url: str | Column,
    content: str | Column,
    published: str | Column,
    keep: Sequence[str] = (),
    trust: Mapping[str, Sequence[str]] = p.SOURCE_TRUST,
    names: Mapping[str, str] = p.SOURCE_NAMES,
    states: Sequence[str] = tuple(STATE_CODES),
    snippet: int = p.SNIPPET_LENGTH,
) -> DataFrame:
    """Raw hits as article rows; missing parts get defaults. Entities come from the whole text."""
    t, u, c = (F.coalesce(as_col(x), F.lit("")) for x in (title, url, content))
    return df.select(
        *keep,
        t.alias("title"),
        u.alias("url"),
        F.substring(c, 1, snippet).alias("snippet"),
        F.coalesce(as_col(published), F.lit("N/A")).alias("published_date"),
        source_name(u, names).alias("source"),
        source_trust(u, trust).alias("source_trust"),
        entities(F.concat(t, F.lit(" "), c), states).alias("entities"),
    ).withColumn("hash", content_hash("title", "snippet"))


def dedupe_by_content(df: DataFrame, content: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each content hash. The heaviest hash thins out before the shuffle."""
    hashed = df.withColumn("hash", content_hash(*content))
    return first_per_key(hashed, "hash", order)


def dedupe_report(df: DataFrame, content: Sequence[str]) -> DataFrame:
    return df.select(content_hash(*content).alias("hash")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("hash").alias("mantidos"),
        (F.count(F.lit(1)) - F.count_distinct("hash")).alias("removidos"),
    )


def relevance(
    text: Column,
    trust: str | Column,
    published: str | Column,
    keywords: Sequence[str] = tuple(p.RELEVANT_WORDS),
    noise: Sequence[str] = tuple(p.NOISE_WORDS),
) -> Column:
    """Score 0..1 from keyword hits, trust of the source, a date and the absence of noise."""
    low = F.lower(text)
    hits = sum((low.contains(w.lower()).cast("int") for w in keywords), F.lit(0))
    dated = as_col(published).isNotNull() & ~as_col(published).isin("", "N/A")
    score = (
        F.least(hits / F.lit(float(len(keywords))), F.lit(1.0)) * p.WORD_WEIGHT
        + first_of([(as_col(trust) == level, F.lit(w)) for level, w in p.TRUST_WEIGHT.items()], F.lit(p.OTHER_TRUST_WEIGHT))
        + F.when(dated, p.DATED_WEIGHT).otherwise(p.UNDATED_WEIGHT)
        + F.when(contains_any(low, [w.lower() for w in noise]), 0.0).otherwise(p.CLEAN_WEIGHT)
    )
    return F.round(score, 3)


def relevance_band(score: str | Column) -> Column:
    return F.when(as_col(score) >= p.HIGH_RELEVANCE, "high").when(as_col(score) >= p.MIN_RELEVANCE, "medium").otherwise("low")


def score_articles(
    articles: DataFrame, keywords: Sequence[str] = tuple(p.RELEVANT_WORDS), noise: Sequence[str] = tuple(p.NOISE_WORDS)
) -> DataFrame:
    text = F.concat("title", F.lit(" "), "snippet")
    return articles.withColumn(
        "relevance_score", relevance(text, "source_trust", "published_date", keywords, noise)
    ).withColumn("relevance", relevance_band("relevance_score"))


def relevant_articles(scored: DataFrame, minimum: float = p.MIN_RELEVANCE, tie: Sequence[str] = ("hash",)) -> DataFrame:
    """Articles that reach the bound, best first."""
    return scored.filter(F.col("relevance_score") >= minimum).orderBy(F.desc("relevance_score"), *tie)


def relevance_counts(scored: DataFrame) -> DataFrame:
    """Articles per source and band."""
    return scored.groupBy("source").agg(
        F.count_if(F.col("relevance") == "high").alias("high"),
        F.count_if(F.col("relevance") == "medium").alias("medium"),
        F.count_if(F.col("relevance") == "low").alias("low"),
        F.count(F.lit(1)).alias("total"),
    )
