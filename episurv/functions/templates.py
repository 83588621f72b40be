"""Document templates and their rendering as a column expression."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text of the four kinds of documents.
KPI_TEMPLATE = """CATEGORIA: {categoria}
MÉTRICA: {metrica}
VALOR ATUAL: {valor} {unidade}
ESCOPO: {escopo}
DATA: {data_snapshot}
DESCRIÇÃO: {descricao}
CONTEXTO: Esta métrica faz parte do monitoramento epidemiológico de SRAG (Síndrome Respiratória Aguda Grave) no Brasil."""

MONTH_TEMPLATE = """PERÍODO: {ano_mes} (mês de referência)
CASOS TOTAIS: {total_casos} notificações de SRAG
TAXA DE MORTALIDADE: {taxa_mortalidade}%
TAXA DE OCUPAÇÃO UTI: {taxa_uti}%
TAXA DE VACINAÇÃO: {taxa_vacinacao}%
CRESCIMENTO MENSAL: {taxa_crescimento}%
ANÁLISE: Em {ano_mes}, foram registrados {total_casos} casos de SRAG no Brasil. 
A taxa de mortalidade foi de {taxa_mortalidade}%, com {taxa_uti}% dos casos necessitando de UTI.
A cobertura vacinal atingiu {taxa_vacinacao}% dos casos notificados.
O crescimento em relação ao mês anterior foi de {taxa_crescimento}%."""

STATE_TEMPLATE = """ESTADO: {sg_uf} (Unidade Federativa do Brasil)
EPIDEMIOLOGIA SRAG:
Total de Casos: {total_casos} notificações registradas
Posição Nacional: {ranking_casos}º lugar no ranking de casos
Representatividade: {percentual_nacional}% do total nacional
INDICADORES DE GRAVIDADE:
Taxa de Mortalidade: {taxa_mortalidade}% (letalidade por SRAG)
Taxa de UTI: {taxa_uti}% (casos que necessitaram terapia intensiva)
Taxa de Vacinação: {taxa_vacinacao}% (cobertura vacinal)
ANÁLISE REGIONAL: O estado {sg_uf} apresenta {total_casos} casos confirmados de Síndrome Respiratória Aguda Grave, posicionando-se como {ranking_casos}º estado brasileiro em número absoluto de notificações. Este volume representa {percentual_nacional}% de todos os casos nacionais. A taxa de mortalidade estadual é de {taxa_mortalidade}%, enquanto {taxa_uti}% dos pacientes necessitaram de internação em UTI.
CONTEXTO EPIDEMIOLÓGICO: {sg_uf} demonstra padrão epidemiológico característico com casos distribuídos ao longo do território estadual. A monitorização contínua permite identificação de surtos e tendências emergentes para ações de saúde pública direcionadas."""

AGE_SEX_TEMPLATE = """PERFIL DEMOGRÁFICO: Faixa etária {faixa_etaria}, sexo {sexo_label}
CASOS: {total_casos} notificações
PERCENTUAL DO TOTAL: {percentual_total}%
INDICADORES:
- Taxa de Mortalidade: {taxa_mortalidade}%
- Taxa de Internação: {taxa_internacao}%
ANÁLISE: O grupo de {faixa_etaria} anos ({sexo_label}) apresentou {total_casos} casos 
de SRAG, representando {percentual_total}% do total nacional. A taxa de mortalidade 
neste grupo foi de {taxa_mortalidade}%, com {taxa_internacao}% dos casos necessitando de internação."""

PLACEHOLDER = re.compile(r"\{(\w+)\}")


def pieces(template: str) -> list[tuple[str, str]]:
    """The template as ('text', literal) and ('field', name) pieces."""
    out, end = [], 0
    for m in PLACEHOLDER.finditer(template):
        if m.start() > end:
            out.append(("text", template[end : m.start()]))
        out.append(("field", m.group(1)))
        end = m.end()
    if end < len(template):
        out.append(("text", template[end:]))
    return out


def render(template: str, fields: Mapping[str, Column]) -> Column:
    """The template with its placeholders filled by text columns."""
    return F.concat(*[F.lit(x) if kind == "text" else fields[x] for kind, x in pieces(template)])
