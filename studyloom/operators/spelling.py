"""Misspelt words of a corpus with their correction, by an index of deleted forms.

A word's deleted forms are itself and what is left after one or two of its characters are taken out. Words within an edit distance
of d have a common form among those with up to d characters deleted on either side, so candidates come from an equi-join on
forms, and the distance is computed for these only. Words are ASCII small letters.

Rare words are the most, and have dozens of forms each; a bitmap of the known words' forms, of bounded size, keeps those that surely
meet none out of the join's shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .lexical import terms

#: A word that occurs so often is known; one that occurs no more than so often may be misspelt.
KNOWN, SUSPECT = 20, 2
#: Shorter words aren't corrected; from so many characters on two edits are looked for.
LEAST_LENGTH, LONG = 4, 8
#: Bits of the bitmap: 32 a form or more, within these bounds. The larger one is 2**19 words, some 30 MB as a broadcast table.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) of docs (text): words of ASCII letters with LEAST_LENGTH characters or more, in small letters."""
    words = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("word"))
    return words.where(f"length(word) >= {LEAST_LENGTH} AND word RLIKE '^[a-z]+$'").groupBy("word").agg(F.count("*").alias("n"))


def _without_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def forms(word: Column) -> Column:
    """The deleted forms of a word: with up to two characters out, or one for short words. Every form of a word's partner within its distance is among the partner's forms of that distance."""
    one = _without_one(word)
    two = F.when(F.length(word) >= LONG - 2, F.flatten(F.transform(one, _without_one))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.concat(F.array(word), one, two))


def _slot(form: Column, bits: int) -> tuple[Column, Column]:
    slot = F.pmod(F.xxhash64(form), F.lit(bits))
    return F.shiftright(slot, 6).cast("int").alias("__word"), F.pmod(slot, F.lit(64)).cast("int").alias("__bit")


def may_meet(rows: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Those of rows (form, ...) whose form may be among known's (form), which are n or less: all that are, and few others unless they are very many."""
    bits = min(max(1 << (32 * n).bit_length(), LEAST_BITS), MOST_BITS)
    bitmap = known.select(*_slot(F.col("form"), bits)).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    both = rows.select("*", *_slot(F.col("form"), bits)).join(F.broadcast(bitmap), "__word")
    return both.where("(shiftright(__bits, __bit) & 1) = 1").select(*rows.columns)


def corrections(docs: DataFrame, known: int = KNOWN, suspect: int = SUSPECT) -> DataFrame:
    """word, n, correction, distance, correction_n: for each rare word the known word within one edit, or two from LONG characters on.

    The nearest known word counts, of these the most frequent one, then the first by name. Words without one have no row; null texts have no words.
    """
    all_words = written(counts(docs))
    rare = all_words.where(F.col("n") <= suspect).select("word", "n", F.explode(forms(F.col("word"))).alias("form"))
    often = all_words.where(F.col("n") >= known).select(F.col("word").alias("correction"), F.col("n").alias("correction_n"), F.explode(forms(F.col("word"))).alias("form"))
    n_forms = all_words.where(F.col("n") >= known).agg(F.expr("sum(1 + length(word) * (length(word) + 1) div 2)")).first()[0] or 0
    rare = may_meet(rare, often, n_forms)
    most = F.when(F.length("word") >= LONG, 2).otherwise(1)
    # a planner would judge the forms by the size of the words' file and broadcast them
    met = rare.join(often.hint("merge"), "form").where(F.abs(F.length("word") - F.length("correction")) <= most).select("word", "n", "correction", "correction_n").distinct()
    near = met.withColumn("distance", F.levenshtein("word", "correction")).where(F.col("distance") <= most)
    best = near.groupBy("word", "n").agg(F.min(F.struct("distance", (-F.col("correction_n")).alias("less"), "correction")).alias("b"))
    return best.select("word", "n", "b.correction", "b.distance", (-F.col("b.less")).alias("correction_n"))


def corrected(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_corrected: how many occurrences of misspelt words each of docs (doc_id, text) has; documents without any are left out.

    The misspelt words come as rows, so the join is on words and neither side is sent whole.
    """
    words = docs.select("doc_id", F.explode(terms(F.coalesce("text", F.lit("")))).alias("word"))
    return words.join(found.select("word"), "word").groupBy("doc_id").agg(F.count("*").alias("n_corrected"))
