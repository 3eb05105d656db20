"""Schemas of the entities. Files are read with them; nothing is inferred."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_NAMED = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "float": T.FloatType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType()}


def _type(text: str) -> T.DataType:
    if m := re.fullmatch(r"array<(.*)>", text):
        return T.ArrayType(_type(m[1]))
    if m := re.fullmatch(r"struct<(.*)>", text):
        return T.StructType([T.StructField(n, _type(t)) for n, t in (f.split(":") for f in m[1].split(","))])
    return _NAMED[text]


def _schema(text: str) -> T.StructType:
    """A schema from "name type, ..."; needs no session, unlike the DDL parser."""
    return T.StructType([T.StructField(f.split(" ")[0], _type(f.split(" ")[1])) for f in text.split(", ")])


CHUNK = _schema(
    "chunk_id string, video_id string, part_no int, video_title string, collection string, short_title string, text_preview string, "
    "topics array<string>, patterns array<string>, has_brand_signal boolean, has_warning boolean"
)
NODE = _schema(
    "node_id string, category string, difficulty string, exam_weight string, prerequisites array<string>, common_failures array<struct<cause:string,symptom:string>>"
)
PATTERN = _schema("pattern_id string, category string, subcategory string, question_variants array<struct<variant_name:string>>")
TECHNIQUE = _schema("id string, name string, desc string")
VECTOR = _schema("pos bigint, embedding array<float>")
USERS = _schema("user_id string, grade string, school string, region string, name string, created_at timestamp_ntz, last_active timestamp_ntz")
PROFILE = _schema("user_id string, weak_topics array<string>, mastered_topics array<string>, learning_goals string, updated_at timestamp_ntz")
HISTORY = _schema(
    "id bigint, user_id string, query string, diagnosis string, diagnosis_summary string, response_summary string, weak_topics_added array<string>, cost double, created_at timestamp_ntz"
)
SUMMARY = _schema("id bigint, user_id string, period string, summary string, compressed_count int, compression_ratio string, created_at timestamp_ntz")
PROVIDER = _schema("provider string, model_default string, context_window int, sdk string, input_miss double, input_hit double, output double")

#: Tables with their keys, and the references between them.
TABLES = {"users": (USERS, "user_id"), "user_profile": (PROFILE, "user_id"), "query_history": (HISTORY, "id"), "memory_summaries": (SUMMARY, "id")}
FOREIGN_KEYS = [("user_profile", "user_id", "users", "user_id"), ("query_history", "user_id", "users", "user_id"), ("memory_summaries", "user_id", "users", "user_id")]
UNIQUE = {"memory_summaries": ["user_id", "period"], "user_profile": ["user_id"]}
