"""Projection, typing and derived columns: raw text records to typed cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episurv.functions.codes import (
    AGE_BANDS,
    CLEAN_COLUMNS,
    DATE_COLUMNS,
    DIED,
    CURED,
    NO,
    SELECTED_COLUMNS,
    SEX_RECODE,
    YES,
)
from episurv.functions.reshape import with_values
from episurv.functions.columns import (
    age_years,
    band,
    flag,
    int_in_range,
    parse_date_multi,
    recode,
    share_filled,
    valid_only,
    year_month,
)


def selected_names(groups: Mapping[str, Sequence[str]] = SELECTED_COLUMNS) -> list[str]:
    return [name for names in groups.values() for name in names]


def select_available(df: DataFrame, groups: Mapping[str, Sequence[str]] = SELECTED_COLUMNS) -> DataFrame:
    """Keep the wanted columns that exist; absent ones are skipped."""
    present = set(df.columns)
    return df.select(*[name for name in selected_names(groups) if name in present])


def column_report(df: DataFrame, groups: Mapping[str, Sequence[str]] = SELECTED_COLUMNS) -> list[tuple[str, str, bool]]:
    """(group, column, present) for every wanted column; schema only, no job."""
    present = set(df.columns)
    return [(g, name, name in present) for g, names in groups.items() for name in names]


def type_cases(df: DataFrame) -> DataFrame:
    """Typed, lower-cased columns.

    Parsed values are computed once, since every later filter reads them. They are made from the
    raw names before any renaming, so the age sees the raw unit whatever the case sensitivity of
    the session.
    """
    parsed: dict[str, Column] = {f"_{c}": parse_date_multi(c) for c in DATE_COLUMNS if c in df.columns}
    if {"NU_IDADE_N", "TP_IDADE"} <= set(df.columns):
        parsed["_NU_IDADE_N"] = age_years("NU_IDADE_N", "TP_IDADE")
    if "SEM_PRI" in df.columns:
        parsed["_SEM_PRI"] = int_in_range("SEM_PRI", 1, 53)
    valued = with_values(df, parsed) if parsed else df

    def typed(name: str) -> Column:
        if f"_{name}" in parsed:
            return F.col(f"_{name}")
        return recode(name, SEX_RECODE) if name == "CS_SEXO" else F.col(name)

    return valued.select(*[typed(c).alias(c.lower()) for c in df.columns])


def add_clean_codes(df: DataFrame, cols: Sequence[str] = CLEAN_COLUMNS, codes: Sequence[str] = (YES, NO)) -> DataFrame:
    """`<col>_clean` holds only the valid codes; the raw column stays."""
    return df.withColumns({f"{c}_clean": valid_only(c, codes) for c in cols if c in df.columns})


def add_date_parts(df: DataFrame, date: str = "dt_sin_pri") -> DataFrame:
    return df.withColumns(
        {
            "ano": F.year(date),
            "mes": F.month(date),
            "dia_semana": F.dayofweek(date),
            "ano_mes": year_month(date),
        }
    )


def add_day_gaps(
    df: DataFrame,
    symptom: str = "dt_sin_pri",
    notified: str = "dt_notific",
    admitted: str = "dt_interna",
    ended: str = "dt_evoluca",
) -> DataFrame:
    """Days between events; NULL when either date is missing."""
    return df.withColumns(
        {
            "tempo_sintoma_notificacao": F.datediff(notified, symptom),
            "tempo_sintoma_internacao": F.datediff(admitted, symptom),
            "tempo_internacao": F.datediff(ended, admitted),
        }
    )


def add_age_features(df: DataFrame, age: str = "nu_idade_n", elderly: int = 60) -> DataFrame:
    return df.withColumns(
        {
            "faixa_etaria": band(age, AGE_BANDS),
            "is_idoso": F.coalesce(F.col(age) >= elderly, F.lit(False)),
        }
    )


def add_flags(df: DataFrame) -> DataFrame:
    """Boolean features; unknown answers are false."""
    features = {
        "is_obito": ("evolucao_clean", DIED),
        "is_cura": ("evolucao_clean", CURED),
        "is_internado": ("hospital_clean", YES),
        "is_uti": ("uti_clean", YES),
        "is_vacinado": ("vacina_clean", YES),
        "has_febre": ("febre", YES),
        "has_tosse": ("tosse", YES),
        "has_dispneia": ("dispneia", YES),
    }
    return df.withColumns({name: flag(c, v) for name, (c, v) in features.items() if c in df.columns})


def add_quality_flags(
    df: DataFrame,
    symptom: str = "dt_sin_pri",
    notified: str = "dt_notific",
    scored: Sequence[str] = ("cs_sexo_clean", "nu_idade_n", "evolucao_clean", "sg_uf"),
) -> DataFrame:
    return df.withColumns(
        {
            "_data_valida": F.coalesce(F.col(symptom) <= F.col(notified), F.lit(False)),
            "_completude_score": share_filled(scored),
        }
    )


def add_features(df: DataFrame) -> DataFrame:
    return add_quality_flags(add_flags(add_age_features(add_day_gaps(add_date_parts(df)))))


def add_lineage(df: DataFrame, process_id: str, layer: str, snapshot: bool = False) -> DataFrame:
    """Processing time and run id; the source year or the snapshot date."""
    out = df.withColumns(
        {f"_{layer}_processed_at": F.current_timestamp(), "_process_id": F.lit(process_id)}
    )
    if snapshot:
        return out.withColumn("data_snapshot", F.current_date())
    return out.withColumn("_source_year", F.col("ano_dados")) if "ano_dados" in df.columns else out


def sample_rows(df: DataFrame, fraction: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """A random sample; with a key the choice depends on the key's hash only, so it is repeatable."""
    if key is None:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10)
    return df.filter(digest.cast("double") < F.lit(fraction * 2.0**32))


def pad_to_schema(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """The columns of a schema in its order; absent ones are typed NULLs."""
    return df.select(
        *[
            (F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n)
            for n, t in schema.items()
        ]
    )
