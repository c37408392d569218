"""Row types of the library's tables, and the fixed values they are read with."""

from __future__ import annotations

from pyspark.sql import types as T

# The complexity labels, most to least complex. Existing corpora carry these exact texts.
LEVEL_4 = "Level 4: JOINs / Set Ops with Subquery"
LEVEL_3 = "Level 3: JOINs / Set Ops without Subquery"
LEVEL_2 = "Level 2: Subquery"
LEVEL_1 = "Level 1: Basic Query"
LEVEL_OTHER = "Other/Uncategorized"
LEVELS = [LEVEL_4, LEVEL_3, LEVEL_2, LEVEL_1, LEVEL_OTHER]

# The share of each label in a curated split.
LEVEL_SHARES = {LEVEL_4: 0.25, LEVEL_3: 0.25, LEVEL_2: 0.25, LEVEL_1: 0.25, LEVEL_OTHER: 0.0}

# Limits and budgets.
MAX_PROMPT_CHARS = 200_000
MAX_CELL_CHARS = 50
SAMPLE_ROW_VARIANTS = [3, 1, 0]
COVERAGE_BUDGET_RATIO = 0.2
COVERAGE_DENSITY = 2
QUERY_TIMEOUT_SEC = 40
RETRY_ATTEMPTS = 5
RETRY_BASE_DELAY_SEC = 4
CHARS_PER_TOKEN = 4

# Status words and messages found in result records.
SUCCESS = "Success"
ERROR = "Error"
FAILURE = "Failure"
CONTEXT_LIMIT = "ContextLimit"
NO_SQL_BLOCK = "ERROR: NO SQL BLOCK FOUND"
CONTEXT_EXCEEDED = "Context length exceeded"

# The separator of a submission line, and the split names.
PREDICTION_SEPARATOR = "\t----- bird -----\t"
TRAIN, VAL_IN, VAL_OUT = "train", "val_in_domain", "val_out_of_domain"
SPLITS = [TRAIN, VAL_IN, VAL_OUT]
# Names under which a published copy stores the same splits.
PUBLISHED_SPLITS = {
    "train": TRAIN,
    "validation_in_domain": VAL_IN,
    "validation_out_of_domain": VAL_OUT,
}

IN_DOMAIN, OUT_OF_DOMAIN = "in_domain", "out_of_domain"
CACHE_SUCCESS, CACHE_FAILED, CACHE_CANDIDATE = "success", "failed", "candidate"


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


QUESTIONS = T.StructType(_strings("question_id", "db_id", "question", "evidence", "gold_sql", "level"))

RESULT_FIELDS = [
    "question_id", "db_id", "question", "gold_sql", "level", "evidence",
    "predicted_sql", "final_reasoning", "generation_status", "execution_match",
    "predicted_exec_status", "error_occurred", "raw_output",
    "prompt_template_string", "error_message",
]
_BOOLEAN_RESULTS = {"execution_match", "predicted_exec_status"}

RESULTS = T.StructType(
    [
        T.StructField(name, T.BooleanType() if name in _BOOLEAN_RESULTS else T.StringType())
        for name in RESULT_FIELDS
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("db_id", T.StringType()),
        T.StructField("table_names_original", T.ArrayType(T.StringType())),
        T.StructField("table_names", T.ArrayType(T.StringType())),
        T.StructField("column_names_original", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("column_names", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("column_types", T.ArrayType(T.StringType())),
        T.StructField("primary_keys", T.ArrayType(T.StringType())),
        T.StructField("foreign_keys", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)

GENERATIONS = T.StructType(_strings("question_id", "raw_content"))
PREDICTIONS = T.StructType(_strings("question_id", "sql", "db_id"))
CURATED = T.StructType(RESULTS.fields + _strings("split"))
