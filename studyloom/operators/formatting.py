"""Projection to a bounded text context, prompts, and answer validation. Templates are our own; section labels are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chosen_phrase, falsy_or, filled_lines, first_of, last_of, prefix

FIRST_MOST, LAST_MOST, TOTAL_MOST = 15, 20, 1500
VIDEO_URL = "https://video.example.com/watch/"
NO_CHUNKS, NO_VIDEOS = "(no matching chunks)", "(no recommended videos)"
OPENINGS = {"diagnostic": ["Let us find the gap.", "Where does it break?"], "simple": ["In short:", "Briefly:"]}
DEFAULT_OPENINGS = ["Step by step:", "Let us see.", "Here we go:"]


def video_url(video_id: Column, part_no: Column) -> Column:
    return F.concat(F.lit(VIDEO_URL), video_id, F.lit("?p="), part_no.cast("string"))


def video_key(video_id: Column, part_no: Column) -> Column:
    return F.concat(video_id, F.lit("#P"), part_no.cast("string"))


def chunk_lines(chunks: Column, n: int = 5) -> Column:
    """chunks: array of struct with video_id, part_no, text_preview."""
    return F.transform(F.slice(chunks, 1, n), lambda c: F.concat(F.lit("  - ["), video_key(c["video_id"], c["part_no"]), F.lit("] "), prefix(c["text_preview"], 150), F.lit("...")))


def chunk_text(chunks: Column) -> Column:
    lines = F.transform(F.slice(chunks, 1, 5), lambda c: F.concat(F.lit("  - ["), prefix(c["chunk_id"].cast("string"), 40), F.lit("]: "), prefix(c["text_preview"], 150), F.lit("...")))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(NO_CHUNKS)


def video_lines(videos: Column, n: int = 3, title: int = 40) -> Column:
    def line(v: Column) -> Column:
        return F.concat(
            F.lit("  - <"), v["collection"], F.lit("> P"), v["part_no"].cast("string"), F.lit(": "),
            F.coalesce(falsy_or(v["short_title"], prefix(v["video_title"], title)), F.lit("")), F.lit("\n    "), video_url(v["video_id"], v["part_no"]),
        )

    return F.transform(F.slice(videos, 1, n), line)


def video_text(videos: Column) -> Column:
    lines = video_lines(videos)
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(NO_VIDEOS)


def context_text(nodes: Column, patterns: Column, techniques: Column, prerequisites: Column, chunks: Column, videos: Column) -> Column:
    """The sections that aren't empty, in a fixed order."""

    def listed(label: str, items: Column, n: int) -> Column:
        some = F.slice(items, 1, n)
        return F.when(F.array_join(some, ", ") != "", F.concat(F.lit(f"{label}: ["), F.array_join(some, ", "), F.lit("]")))

    def block(label: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"{label}:\n"), F.array_join(lines, "\n")))

    # fixed values: the labels of sections, which prompts refer to
    sections = F.array(
        listed("related_nodes", nodes, 5), listed("related_patterns", patterns, 3), listed("recommended_thinking", techniques, 3),
        listed("prerequisites_to_check", prerequisites, 5), block("reference_chunks", chunk_lines(chunks)), block("recommended_videos", video_lines(videos)),
    )
    return F.array_join(F.filter(sections, lambda s: s.isNotNull()), "\n")


def opening(query: Column, complexity: Column) -> Column:
    out = F
    for name, phrases in OPENINGS.items():
        out = out.when(complexity == name, chosen_phrase(query, phrases))
    return out.otherwise(chosen_phrase(query, DEFAULT_OPENINGS))


def prompt(query: Column, complexity: Column, context: Column) -> Column:
    """A concise prompt for simple questions, else a full one."""
    concise = F.concat(F.lit("Question: "), query, F.lit("\nAnswer in three sentences. Begin with: "), opening(query, complexity))
    full = F.concat(F.lit("Question: "), query, F.lit("\n\n[RETRIEVAL_RESULTS]\n"), context, F.lit("\n\nExplain the cause, the steps and one exercise. Begin with: "), opening(query, complexity))
    return F.when(complexity == "simple", concise).otherwise(full)


def messages(df: DataFrame, base: str) -> DataFrame:
    """system (stable: prompt and profile) and user (volatile: history and question), kept apart for a provider's prefix cache."""
    return df.withColumn("system", F.concat_ws("\n\n", F.lit(base), F.col("static_text"))).withColumn("user", F.concat_ws("\n\n", F.col("recent_text"), F.col("prompt")))


def validated(df: DataFrame, answer: str) -> DataFrame:
    """df with first_line_len, last_line_len, total_chars, issues (array of code and length) and valid."""
    lines = filled_lines(F.col(answer))
    out = df.withColumn("__lines", lines).withColumn("first_line_len", F.length(first_of(F.col("__lines")))).withColumn("last_line_len", F.length(last_of(F.col("__lines")))).withColumn("total_chars", F.length(answer))

    def issue(column: str, most: int, code: str) -> Column:
        return F.when(F.col(column) > most, F.concat(F.lit(f"{code} "), F.col(column).cast("string"), F.lit(f" > {most}")))

    issues = F.array(issue("first_line_len", FIRST_MOST, "opening"), issue("last_line_len", LAST_MOST, "closing"), issue("total_chars", TOTAL_MOST, "total"))
    return out.withColumn("issues", F.filter(issues, lambda x: x.isNotNull())).withColumn("valid", F.size("issues") == 0).drop("__lines")


def answer_checks(answer: Column) -> dict[str, Column]:
    """Format tests of an answer: a bracketed collection, a video link, a doubled id prefix, a well-formed video reference."""
    return {
        "has_collection": F.contains(answer, F.lit("<")) & F.contains(answer, F.lit(">")),
        "has_url": F.contains(answer, F.lit(VIDEO_URL)),
        "has_doubled_id": F.contains(answer, F.lit("srcsrc")),
        "has_reference": F.regexp_like(answer, F.lit(r"<[^<>\n]+> P[0-9]+: [^\n]*\n\s*https://\S+\?p=[0-9]+")),
    }
