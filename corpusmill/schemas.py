"""Explicit schemas; nothing on a hot path is inferred."""

from pyspark.sql import types as T

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
CHAT_FROM_VALUE = "id bigint, conversations array<struct<from:string,value:string>>"
CHAT_ROLE_CONTENT = "id bigint, conversations array<struct<role:string,content:string>>"
PAIR = (
    "id bigint, instruction string, prompt string, response string, output string, "
    "completion string, system string"
)
RAW_TEXT = "id bigint, text string"
MIXED = "text string, type string, length int, source string, source_index bigint"
PROMPTS = "category string, prompt string, expected_elements array<string>, max_tokens int"
COMPONENTS = "struct<clarity:double,response_quality:double,diversity:double,complexity:double>"
SCORE_STORE = f"pair_key string, score double, components {COMPONENTS}"
SCORE_CSV = (
    "idx bigint, score double, clarity double, response_quality double, diversity double, complexity double"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
