"""Query classification by signal tables. The word lists are inputs; the defaults are neutral."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_keyword, keyword_hits

GRADES = {"first": ["begin", "basic", "the ", "un "], "second": ["second", "form", "der ", "con "], "third": ["final", "exam", "tion", "que "]}
COMPLEXITY = {"diagnostic": ["wrong", "fail", "idiot"], "complex": ["prove", "derive", "token"], "simple": ["what is", "define", "page"]}
SHORT = 20
DEPTHS = {"first": 1, "second": 2, "third": 3, "unknown": 2}


def grade(text: Column, signals: dict[str, list[str]] = GRADES) -> Column:
    """The label with most hits, the first of equals; 'unknown' without any."""
    hits = {g: keyword_hits(text, words) for g, words in signals.items()}
    most = F.greatest(*hits.values())
    label = F.coalesce(*[F.when(h == most, F.lit(g)) for g, h in hits.items()])
    return F.when(most == 0, F.lit("unknown")).otherwise(label)


def complexity(text: Column, signals: dict[str, list[str]] = COMPLEXITY) -> Column:
    """The first of diagnostic, complex, simple with a signal; else simple under 20 characters, or normal."""
    out = F
    for name in ("diagnostic", "complex", "simple"):
        out = out.when(any_keyword(text, signals[name]), F.lit(name))
    return out.when(F.length(text) < SHORT, F.lit("simple")).otherwise(F.lit("normal"))


def depth_of(grade_column: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DEPTHS.items() for x in kv]), grade_column), F.lit(2))
