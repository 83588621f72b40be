"""Word lists, patterns and domain lists of the text rules."""

# Java flags that read a pattern the way it is meant: Unicode word letters, `.` stops at \n only.
FLAGS = "(?Ud)"
FLAGS_ANY_CASE = "(?Uiud)"

# Question classes and the patterns that reveal them, in order.
INTENT_PATTERNS = {
    "factual": [
        r"\b(quantos?|qual|quanto|quem)\b",
        r"\b(total|número|quantidade)\b",
        r"\b(casos|óbitos|mortes)\b.*\b(em|de)\b",
    ],
    "analytical": [
        r"\b(por que|porque|motivo|razão|causa)\b",
        r"\b(analis[ae]|avaliar|explicar|entender)\b",
        r"\b(impacto|efeito|consequência)\b",
    ],
    "comparative": [
        r"\b(comparar|versus|vs|diferença)\b",
        r"\b(maior|menor|melhor|pior)\b.*\b(que|do que)\b",
        r"\b(entre|e)\b.*\b(estados?|UFs?)\b",
    ],
    "temporal": [
        r"\b(tendência|evolução|crescimento)\b",
        r"\b(últimos?|próximos?|passados?)\b.*\b(meses?|anos?)\b",
        r"\b(temporal|ao longo|série)\b",
    ],
    "geographic": [
        r"\b(estado|UF|região|mapa)\b",
        r"\b(ranking|top|principais)\b.*\b(UFs?|estados?)\b",
        r"\b(SP|RJ|MG|BA|RS|PR|SC|CE|PE)\b",
    ],
    "demographic": [
        r"\b(idade|idoso|criança|adulto)\b",
        r"\b(sexo|feminino|masculino|gênero)\b",
        r"\b(faixa etária|grupo etário)\b",
    ],
    "explanatory": [
        r"\b(o que é|como|defin[ae])\b",
        r"\b(significa|conceito|explicar)\b",
        r"\b(taxa de|métrica|indicador)\b",
    ],
}
DEFAULT_INTENT = "factual"

# Strategy per class when it is the only one.
INTENT_STRATEGY = {
    "factual": "sql_only",
    "analytical": "rag_only",
    "comparative": "hybrid",
    "temporal": "hybrid",
    "geographic": "sql_only",
    "demographic": "sql_only",
    "explanatory": "rag_only",
}

# Tables per class, the default for other classes, and tables by keyword.
INTENT_TABLES = {
    "temporal": ["metricas_temporais", "series_temporais"],
    "geographic": ["metricas_geograficas"],
    "demographic": ["metricas_demograficas"],
    "factual": ["metricas_temporais"],
    "analytical": ["resumo_geral"],
    "explanatory": ["resumo_geral"],
}
DEFAULT_TABLES = ["metricas_temporais"]
KEYWORD_TABLES = {
    "metricas_geograficas": ["estado", "uf", "sp", "rj", "região"],
    "metricas_demograficas": ["idade", "idoso", "sexo", "faixa"],
    "series_temporais": ["tendência", "evolução", "série"],
}

# Document type per class, in class order; confidence steps and their keywords.
INTENT_DOCUMENT_TYPE = {
    "temporal": "temporal",
    "geographic": "geographic",
    "demographic": "demographic",
    "explanatory": "metric",
}
CONFIDENT_WORDS = ["quantos", "qual", "ranking", "total"]

# Question types by keyword, in order.
QUESTION_TYPES = {
    "factual": ["quantos", "qual", "quanto", "quem"],
    "comparative": ["maior", "menor", "melhor", "pior", "comparar"],
    "temporal": ["quando", "período", "mês", "ano", "tendência"],
    "geographic": ["onde", "estado", "uf", "região"],
    "explanatory": ["por que", "como", "explicar", "motivo"],
}

# Phrases of an answer that says nothing, and the texts of the issues.
GENERIC_PHRASES = ["não tenho informação", "não posso responder", "não há dados"]
ISSUE_SHORT = "Resposta muito curta ou vazia"
ISSUE_NO_SOURCE = "Nenhum documento recuperado"
ISSUE_GENERIC = "Resposta genérica apesar de ter fontes"

# Terms that ask for a document type.
GEOGRAPHIC_TERMS = ["estado", "uf"]
TEMPORAL_TERMS = ["mês", "ano", "2024", "2025", "tendência", "janeiro", "dezembro"]

# Personal data as (pattern, type), in order of replacement.
PII_PATTERNS = [
    (r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", "CPF"),
    (r"\b\d{11}\b", "CPF_SEM_FORMATO"),
    (r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", "CNPJ"),
    (r"\b\(\d{2}\)\s*\d{4,5}-\d{4}\b", "TELEFONE"),
    (r"\b[A-ZÀ-Ú][a-zà-ú]+\s+[A-ZÀ-Ú][a-zà-ú]+\b", "NOME"),
    (r"\b\d{2}/\d{2}/\d{4}\b", "DATA"),
    (r"\b\d{5}-\d{3}\b", "CEP"),
]
PII_TOKEN = "[REDACTED]"
PII_COLUMNS = [
    "nu_notific", "nu_cpf", "nm_paciente", "nm_mae_pac", "nu_telefone",
    "ds_endereco", "no_bairro", "co_mun_not", "dt_nasc",
]

# Rules for SQL texts.
MAX_QUERY_LENGTH, MAX_LIMIT = 5000, 10000
INJECTION_PATTERNS = [
    r"';.*--",
    r"union\s+select",
    r";\s*drop\s+",
    r";\s*delete\s+",
    r"'\s+or\s+'1'\s*=\s*'1",
    r"--",
    r"/\*.*\*/",
    r"xp_\w+",
    r"sp_\w+",
    r"exec\s*\(",
    r"char\s*\(",
    r"concat\s*\(",
]
FORBIDDEN_VERBS = [
    "DROP", "DELETE", "TRUNCATE", "ALTER", "CREATE",
    "INSERT", "UPDATE", "GRANT", "REVOKE", "EXEC",
    "EXECUTE", "MERGE", "REPLACE", "RENAME",
    "COMMENT", "CALL", "PREPARE", "DEALLOCATE",
]
ALLOWED_TABLES = [
    "gold_metricas_temporais",
    "gold_metricas_geograficas",
    "gold_metricas_demograficas",
    "gold_series_temporais",
    "gold_resumo_geral",
    "gold_analise_avancada",
    "vw_dashboard_principal",
    "vw_metricas_ultimos_6_meses",
    "vw_top10_ufs",
    "vw_alertas_mortalidade",
]
FORBIDDEN_SCHEMAS = ["bronze", "silver", "raw"]

# Rules for free text of users.
DANGEROUS_INPUT = [r";\s*DROP", r";\s*DELETE", r"--", r"/\*", r"\*/", r"xp_", r"sp_", r"exec\s*\(", r"'.*or.*'.*=.*'"]
SPECIAL_CHARACTERS = r"[;\-'\"\\]"
MAX_SPECIAL = 5

# Sources by trust, list order wins, and their names.
SOURCE_TRUST = {
    "official": ["saude.gov.br", "who.int", "paho.org", "fiocruz.br"],
    "mainstream": [
        "g1.globo.com", "uol.com.br", "estadao.com.br", "folha.uol.com.br", "cnnbrasil.com.br", "oglobo.globo.com",
    ],
    "specialized": ["drauziovarella.uol.com.br", "pebmed.com.br", "medscape.com"],
}
OTHER_SOURCE = "other"
SOURCE_NAMES = {
    "g1.globo.com": "G1",
    "saude.gov.br": "Ministério da Saúde",
    "estadao.com.br": "Estadão",
    "folha.uol.com.br": "Folha de S.Paulo",
    "uol.com.br": "UOL",
    "cnnbrasil.com.br": "CNN Brasil",
    "oglobo.globo.com": "O Globo",
    "fiocruz.br": "Fiocruz",
    "who.int": "OMS",
}

# Relevance words, weights and bands.
RELEVANT_WORDS = [
    "srag", "síndrome respiratória", "casos", "mortalidade",
    "internação", "uti", "vacinação", "ministério da saúde",
    "vigilância epidemiológica", "notificação",
]
NOISE_WORDS = ["horóscopo", "futebol", "entretenimento", "celebridade"]
WORD_WEIGHT = 0.4
TRUST_WEIGHT = {"official": 0.3, "mainstream": 0.25, "specialized": 0.20}
OTHER_TRUST_WEIGHT = 0.10
DATED_WEIGHT, UNDATED_WEIGHT, CLEAN_WEIGHT = 0.2, 0.1, 0.1
HIGH_RELEVANCE, MIN_RELEVANCE = 0.7, 0.5
SNIPPET_LENGTH = 300

# Numbers in running text.
PERCENT_PATTERN = r"\b\d+(?:,\d+)?%"
NUMBER_PATTERN = r"\b\d+(?:\.\d+)?(?:\s*mil|\s*milhão|\s*milhões)?\b"
