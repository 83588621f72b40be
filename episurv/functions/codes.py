"""Domain codes, field lists, bands and thresholds of the notification data model."""

# Answer codes. 9 is a category of its own, not a missing value.
YES, NO, IGNORED = "1", "2", "9"
CURED, DIED = "1", "2"
AGE_UNIT_YEARS = "3"
DATE_FORMATS = ("dd/MM/yyyy", "yyyy-MM-dd")

# The 29 columns kept for analysis, in 7 groups.
SELECTED_COLUMNS = {
    "identificacao": ["NU_NOTIFIC"],
    "temporal": ["DT_NOTIFIC", "DT_SIN_PRI", "SEM_PRI", "ANO_DADOS"],
    "demografia": ["CS_SEXO", "NU_IDADE_N", "TP_IDADE", "SG_UF", "CO_MUN_RES", "CS_RACA"],
    "sintomas": ["FEBRE", "TOSSE", "DISPNEIA", "GARGANTA", "SATURACAO", "DESC_RESP"],
    "internacao": ["HOSPITAL", "DT_INTERNA", "UTI", "DT_ENTUTI", "SUPORT_VEN"],
    "desfecho": ["EVOLUCAO", "DT_EVOLUCA", "CLASSI_FIN"],
    "vacinacao": ["VACINA", "VACINA_COV", "DOSE_1_COV", "DOSE_2_COV"],
}
DATE_COLUMNS = ["DT_NOTIFIC", "DT_SIN_PRI", "DT_INTERNA", "DT_ENTUTI", "DT_EVOLUCA"]
CLEAN_COLUMNS = ["evolucao", "uti", "vacina", "hospital", "cs_sexo"]
SEX_RECODE = {"M": "1", "F": "2"}

# Age bands as (upper bound, label), left-closed; the last has no bound.
AGE_BANDS = [
    (1, "0-1 ano"),
    (5, "1-4 anos"),
    (10, "5-9 anos"),
    (18, "10-17 anos"),
    (30, "18-29 anos"),
    (40, "30-39 anos"),
    (50, "40-49 anos"),
    (60, "50-59 anos"),
    (70, "60-69 anos"),
    (None, "70+ anos"),
]
AGE_BANDS_COARSE = [
    (18, "0-17"),
    (30, "18-29"),
    (40, "30-39"),
    (50, "40-49"),
    (60, "50-59"),
    (70, "60-69"),
    (None, "70+"),
]
UNKNOWN_BAND = "Desconhecido"

# Labels of codes.
SEX_LABELS = {"1": "Masculino", "2": "Feminino"}
SEX_UNKNOWN = "Não informado"
OUTCOME_LABELS = {"1": "Cura", "2": "Óbito"}
ICU_LABELS = {"1": "Sim (UTI)", "2": "Não (Enfermaria)"}
VACCINE_LABELS = {"1": "Sim (Vacinado)", "2": "Não (Não Vacinado)"}

# Quality checks. 20 critical fields in 8 groups.
CRITICAL_FIELDS = {
    "identificacao": ["NU_NOTIFIC"],
    "temporal": ["DT_NOTIFIC", "DT_SIN_PRI", "SEM_PRI"],
    "localizacao": ["SG_UF", "CO_MUN_RES"],
    "demografia": ["CS_SEXO", "NU_IDADE_N", "TP_IDADE"],
    "sintomas": ["FEBRE", "TOSSE", "DISPNEIA", "SATURACAO"],
    "internacao": ["HOSPITAL", "DT_INTERNA", "UTI"],
    "desfecho": ["EVOLUCAO", "DT_EVOLUCA"],
    "vacinacao": ["VACINA", "VACINA_COV"],
}
VALID_VALUES = {
    "CS_SEXO": ["M", "F", "I"],
    "FEBRE": ["1", "2", "9"],
    "TOSSE": ["1", "2", "9"],
    "DISPNEIA": ["1", "2", "9"],
    "SATURACAO": ["1", "2", "9"],
    "HOSPITAL": ["1", "2", "9"],
    "UTI": ["1", "2", "9"],
    "EVOLUCAO": ["1", "2", "9"],
    "VACINA": ["1", "2", "9"],
}
DATE_ORDER_PAIRS = [
    ("DT_SIN_PRI", "DT_NOTIFIC"),
    ("DT_SIN_PRI", "DT_INTERNA"),
    ("DT_INTERNA", "DT_ENTUTI"),
    ("DT_INTERNA", "DT_EVOLUCA"),
]
IGNORED_CODE_FIELDS = ["CS_RACA", "FEBRE", "TOSSE", "DISPNEIA", "HOSPITAL", "UTI", "EVOLUCAO", "VACINA"]
YEARLY_NULL_FIELDS = ["DT_SIN_PRI", "EVOLUCAO", "UTI", "VACINA"]
MISSING_FIELDS = [
    "DT_SIN_PRI", "DT_NOTIFIC", "SEM_PRI",
    "CS_SEXO", "NU_IDADE_N", "SG_UF",
    "FEBRE", "TOSSE", "DISPNEIA", "SATURACAO",
    "HOSPITAL", "UTI", "EVOLUCAO",
    "VACINA", "VACINA_COV",
]
ASSOCIATION_FIELDS = ["CS_SEXO", "FEBRE", "TOSSE", "DISPNEIA", "SATURACAO", "HOSPITAL", "UTI", "EVOLUCAO"]
MAX_FILTER_LOSS_PCT = 40.0
MAX_LOAD_LOSS_PCT = 60.0

# State codes and month names.
STATE_CODES = (
    "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()
)
MONTH_NAMES = [
    "janeiro", "fevereiro", "março", "abril", "maio", "junho",
    "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
]
