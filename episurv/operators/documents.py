"""Gold rows as text documents, their validation, and the rows of the search table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episurv.functions import templates as t
from episurv.functions.columns import as_col
from episurv.functions.documents import content_hash, fixed, thousands

# Defaults of the search columns and the budget of a context.
SEARCH_DEFAULTS = {
    "source_table": "unknown",
    "semantic_type": "general",
    "categoria": "geral",
    "metrica": "indefinida",
    "uf": "BR",
    "ano_mes": "2024-01",
    "faixa_etaria": "todas",
}
MAX_CONTEXT = 8000


def plain_number(c: str | Column) -> Column:
    """A double without an exponent: whole values with one zero digit, others as they are."""
    x = as_col(c).cast("double")
    return F.when(x == F.floor(x), F.format_string("%.1f", x)).otherwise(x.cast("string"))


def _documents(
    df: DataFrame, content: Column, doc_id: Column, source: str, kind: str, metadata: Mapping[str, Column]
) -> DataFrame:
    pairs = [x for name, value in metadata.items() for x in (F.lit(name), value.cast("string"))]
    return df.select(
        content.alias("content"),
        F.create_map(*pairs).alias("metadata"),
        doc_id.alias("doc_id"),
        F.lit(source).alias("source_table"),
        F.lit(kind).alias("semantic_type"),
    )


def kpi_documents(kpis: DataFrame) -> DataFrame:
    """One document per KPI row and snapshot date."""
    date = F.col("data_snapshot").cast("string")
    value = plain_number("valor")
    names = ("categoria", "metrica", "unidade", "descricao", "escopo")
    fields = {**{n: F.col(n) for n in names}, "valor": value, "data_snapshot": date}
    return _documents(
        kpis,
        t.render(t.KPI_TEMPLATE, fields),
        F.concat_ws("_", F.lit("resumo"), "categoria", "metrica", date),
        "gold_resumo_geral",
        "metric",
        {
            "categoria": F.col("categoria"), "metrica": F.col("metrica"), "valor": value,
            "unidade": F.col("unidade"), "escopo": F.col("escopo"), "data_snapshot": date,
        },
    )


def month_documents(monthly: DataFrame, months: int = 24) -> DataFrame:
    """One document per month, the newest months only. A month without growth says so."""
    newest = monthly.orderBy(F.desc("ano_mes")).limit(months)
    rates = {n: fixed(n) for n in ("taxa_mortalidade", "taxa_uti", "taxa_vacinacao")}
    fields = {
        "ano_mes": F.col("ano_mes"), "total_casos": thousands("total_casos"), **rates,
        "taxa_crescimento": fixed("taxa_crescimento", signed=True),
    }
    return _documents(
        newest, t.render(t.MONTH_TEMPLATE, fields), F.concat_ws("_", F.lit("temporal"), "ano_mes"),
        "gold_metricas_temporais", "temporal",
        {
            "ano_mes": F.col("ano_mes"), "total_casos": F.col("total_casos"), "taxa_mortalidade": rates["taxa_mortalidade"],
            "taxa_uti": rates["taxa_uti"], "tipo": F.lit("temporal_mensal"),
        },
    )


def state_documents(states: DataFrame) -> DataFrame:
    """One document per state."""
    rates = {n: fixed(n) for n in ("taxa_mortalidade", "taxa_uti", "taxa_vacinacao", "percentual_nacional")}
    fields = {
        "sg_uf": F.col("sg_uf"), "total_casos": thousands("total_casos"),
        "ranking_casos": F.col("ranking_casos").cast("string"), **rates,
    }
    return _documents(
        states, t.render(t.STATE_TEMPLATE, fields), F.concat_ws("_", F.lit("geo"), "sg_uf"),
        "gold_metricas_geograficas", "geographic",
        {
            "uf": F.col("sg_uf"), "total_casos": F.col("total_casos"), "ranking": F.col("ranking_casos"),
            "tipo": F.lit("geographic_profile"),
        },
    )


def age_sex_documents(profile: DataFrame) -> DataFrame:
    """One document per age band and sex."""
    rates = {n: fixed(n) for n in ("taxa_mortalidade", "taxa_internacao", "percentual_total")}
    fields = {
        "faixa_etaria": F.col("faixa_etaria"), "sexo_label": F.col("sexo_label"),
        "total_casos": thousands("total_casos"), **rates,
    }
    return _documents(
        profile.filter(F.col("faixa_etaria").isNotNull()), t.render(t.AGE_SEX_TEMPLATE, fields),
        F.concat_ws("_", F.lit("demo"), "faixa_etaria", "sexo_label"),
        "gold_metricas_demograficas", "demographic",
        {
            "faixa_etaria": F.col("faixa_etaria"), "sexo": F.col("sexo_label"), "total_casos": F.col("total_casos"),
            "tipo": F.lit("demographic_profile"),
        },
    )


def all_documents(
    kpis: DataFrame | None = None,
    monthly: DataFrame | None = None,
    states: DataFrame | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Documents of the given gold tables as one table."""
    parts = [
        make(df)
        for make, df in (
            (kpi_documents, kpis), (month_documents, monthly), (state_documents, states), (age_sex_documents, profile),
        )
        if df is not None
    ]
    return reduce(DataFrame.unionByName, parts)


def document_statistics(docs: DataFrame, kind: str = "semantic_type", content: str = "content") -> DataFrame:
    """Documents and characters per type, with the totals over all types."""
    by_type = docs.groupBy(kind).agg(F.count(F.lit(1)).alias("documentos"), F.sum(F.length(content)).alias("caracteres"))
    whole = Window.partitionBy()
    return by_type.withColumns(
        {
            "media_caracteres": F.round(F.col("caracteres") / F.col("documentos"), 2),
            "total_documentos": F.sum("documentos").over(whole),
            "total_caracteres": F.sum("caracteres").over(whole),
            "media_geral": F.round(F.sum("caracteres").over(whole) / F.sum("documentos").over(whole), 2),
        }
    )


def validate_documents(docs: DataFrame, content: str = "content", doc_id: str = "doc_id") -> DataFrame:
    """Drop blank texts, trim the others, give a missing id the hash of its text."""
    text = F.regexp_replace(F.col(content), r"(?U)^\s+|\s+$", "")
    filled = F.when(F.coalesce(F.col(doc_id).cast("string"), F.lit("")) != "", F.col(doc_id).cast("string"))
    return (
        docs.withColumn(content, text)
        .filter(F.coalesce(F.col(content), F.lit("")) != "")
        .withColumn(doc_id, F.coalesce(filled, F.concat(F.lit("auto_"), content_hash(content))))
    )


def embedding_rows(docs: DataFrame, vector: str = "embedding", metadata: str = "metadata") -> DataFrame:
    """Rows of the search table: filter columns that are never NULL, and all metadata as JSON."""
    meta = F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>"))
    columns = []
    for name, default in SEARCH_DEFAULTS.items():
        own = F.col(name) if name in docs.columns else F.lit(None).cast("string")
        columns.append(F.coalesce(own, F.try_element_at(meta, F.lit(name)), F.lit(default)).alias(name))
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), "content", vector, *columns,
        F.to_json(meta).alias("metadata_json"), F.current_timestamp().alias("created_at"),
    )


def wrong_dimensions(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is missing or not of the expected length; all rows are tested."""
    return df.filter(F.col(vector).isNull() | (F.size(vector) != dim))


def require_dimensions(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """The same rows; a wrong vector fails the job that reads it, without a pass of its own."""
    message = F.concat(F.lit(f"vector dimension: expected {dim}, found "), F.size(vector).cast("string"))
    checked = F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(message).cast(df.schema[vector].dataType))
    return df.withColumn(vector, checked)


def fill_missing_vectors(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Zero vectors where there is none, and a flag that keeps them out of the search."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return df.withColumns(
        {"sem_vetor": F.col(vector).isNull(), vector: F.coalesce(F.col(vector).cast("array<float>"), zero)}
    )


# --- contexts -------------------------------------------------------------------------------


def _within_budget(parts: DataFrame, query: str, rank: str) -> DataFrame:
    """Running length of the parts of each query in rank order. A query holds its top k rows only."""
    so_far = F.sum(F.length("_part")).over(Window.partitionBy(query).orderBy(rank))
    return parts.withColumn("_end", so_far)


def _joined(condition: Column, rank: str) -> Column:
    ordered = F.sort_array(F.collect_list(F.when(condition, F.struct(F.col(rank).alias("r"), F.col("_part").alias("p")))))
    return F.array_join(F.transform(ordered, lambda x: x["p"]), "")


def build_context(
    ranked: DataFrame, query: str, rank: str = "rank", content: str = "content", max_length: int = MAX_CONTEXT,
    metadata: bool = True,
) -> DataFrame:
    """Found documents as one text per query, in rank order, until the next would break the budget."""
    head = [F.lit("**DOCUMENTO "), F.col(rank).cast("string"), F.lit(":**\n")]
    if metadata:
        head += [F.lit("Fonte: "), F.coalesce(F.col("source_table"), F.lit("N/A")), F.lit("\nTipo: "),
                 F.coalesce(F.col("semantic_type"), F.lit("N/A")), F.lit("\n")]
        for name, label in (("ano_mes", "Período: "), ("uf", "Estado: ")):
            if name in ranked.columns:
                line = F.concat(F.lit(label), F.col(name), F.lit("\n"))
                head.append(F.coalesce(line, F.lit("")))
        head.append(F.lit("\n"))
    parts = ranked.withColumn("_part", F.concat(*head, F.col(content), F.lit("\n\n---\n\n")))
    fits = F.col("_end") <= max_length
    return _within_budget(parts, query, rank).groupBy(query).agg(
        F.count_if(fits).alias("documentos"), _joined(fits, rank).alias("contexto")
    )


def context_with_citations(
    ranked: DataFrame, query: str, rank: str = "rank", content: str = "content", max_length: int = MAX_CONTEXT
) -> DataFrame:
    """Numbered documents as one text, and the citations. The first that no longer fits is still cited."""
    mark = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("]"))
    parts = ranked.withColumn("_part", F.concat(mark, F.lit(" "), F.col(content), F.lit("\n\n")))
    fits = F.col("_end") <= max_length
    reached = (F.col("_end") - F.length("_part")) <= max_length
    cited = F.struct(
        F.col(rank).alias("r"),
        mark.alias("k"),
        F.to_json(
            F.struct(
                F.coalesce("source_table", F.lit("N/A")).alias("source_table"),
                F.coalesce("semantic_type", F.lit("N/A")).alias("semantic_type"),
                F.col("doc_id").cast("string").alias("doc_id"),
            )
        ).alias("v"),
    )
    entries = F.transform(
        F.sort_array(F.collect_list(F.when(reached, cited))), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))
    )
    return _within_budget(parts, query, rank).groupBy(query).agg(
        _joined(fits, rank).alias("contexto"), F.map_from_entries(entries).alias("citacoes")
    )
