"""Learner-history analytics: windows, daily and monthly figures, quarter compaction. The clock is an argument (as_of)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import falsy_or, ordered_text, prefix

RECENT_DAYS, OLD_DAYS = 30, 90
#: Status asks for more than STATUS_OVER old rows; compaction itself runs from COMPACT_FROM on.
STATUS_OVER, COMPACT_FROM = 30, 30
TOPIC_CAP = 20
NO_HISTORY = "(no records in the last 30 days)"
NO_SUMMARY = "(first use, no archive yet)"
NO_GRADE = "not set"


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def recent(history: DataFrame, as_of: str, days: int = RECENT_DAYS) -> DataFrame:
    return history.where(F.col("created_at") >= at(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def old(history: DataFrame, as_of: str, days: int = OLD_DAYS) -> DataFrame:
    return history.where(F.col("created_at") < at(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def visible(rows: DataFrame, users: DataFrame | None) -> DataFrame:
    """The rows of the given users (user_id) only. Callers that read history on someone's behalf name the users: None is refused."""
    if users is None:
        raise ValueError("history is read for named users")
    return rows.join(users.select("user_id").where("user_id IS NOT NULL").distinct(), "user_id", "left_semi")


class Own:
    """The tables of an application as some users may see them: whatever is read through it holds their rows only.

    It is what code that acts for users is given, in place of the tables. Tables without a user_id aren't shown.
    """

    def __init__(self, users: DataFrame, tables: dict[str, DataFrame]):
        self._tables = {name: visible(rows, users) for name, rows in tables.items() if "user_id" in rows.columns}
        self.users = users.select("user_id").where("user_id IS NOT NULL").distinct()

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def recent_text(self, as_of: str) -> DataFrame:
        return recent_text(self.users, self["query_history"], as_of)

    def month_cost(self, month: str) -> DataFrame:
        return month_cost(self["query_history"], month)

    def compact(self, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return compact(self["query_history"], self["memory_summaries"], as_of)

    def profiles(self) -> DataFrame:
        return profiles(self.users, self["users"], self["user_profile"])


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def stamp_text(ts: Column) -> Column:
    """As names of exports have it: day and time without separators."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def period(ts: Column) -> Column:
    """YYYY-Qn"""
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def profiles(ids: DataFrame, users: DataFrame, profile: DataFrame) -> DataFrame:
    """One row for each id, also where both tables lack it; null arrays as empty."""
    none = F.expr("cast(array() as array<string>)")
    joined = ids.join(users, "user_id", "left").join(profile, "user_id", "left")
    return joined.withColumn("weak_topics", F.coalesce("weak_topics", none)).withColumn("mastered_topics", F.coalesce("mastered_topics", none)).withColumn("learning_goals", F.coalesce("learning_goals", F.lit("")))


def merged_topics(existing: Column, new: Column, cap: int = TOPIC_CAP) -> Column:
    """Existing topics, then new ones, each once, at most cap."""
    none = F.expr("cast(array() as array<string>)")
    return F.slice(F.array_union(F.coalesce(existing, none), F.coalesce(new, none)), 1, cap)


def recent_text(ids: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """user_id, recent_text: the lines of the last 30 days, latest first."""
    line = F.concat(F.lit("- ["), day_text(F.col("created_at")), F.lit("] asked: "), prefix(F.coalesce("query", F.lit("")), 80), F.lit(" -> found: "), prefix(F.coalesce("diagnosis_summary", F.lit("")), 100))
    own = recent(history, as_of).withColumn("line", line).groupBy("user_id").agg(ordered_text(F.struct("created_at", "id"), F.col("line"), descending=True).alias("lines"))
    return ids.join(own, "user_id", "left").select("user_id", F.coalesce("lines", F.lit(NO_HISTORY)).alias("recent_text"))


def static_text(profiled: DataFrame, summaries: DataFrame) -> DataFrame:
    """user_id, static_text: profile and quarter summaries, in order of period. It changes seldom, so a prompt may begin with it."""
    block = F.concat(F.lit("### "), F.col("period"), F.lit("\n"), F.col("summary"))
    own = summaries.groupBy("user_id").agg(ordered_text(F.col("period"), block, "\n\n").alias("archive"))
    joined = profiled.join(own, "user_id", "left")
    text = F.concat(
        F.lit("[USER_PROFILE]\ngrade: "), falsy_or(F.col("grade"), F.lit(NO_GRADE)),
        F.lit("\nweak_topics: ["), F.array_join("weak_topics", ", "), F.lit("]\nmastered_topics: ["), F.array_join("mastered_topics", ", "),
        F.lit("]\n\n[HISTORICAL_SUMMARIES]\n"), F.coalesce("archive", F.lit(NO_SUMMARY)),
    )
    return joined.select("user_id", text.alias("static_text"))


def full_text(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    return static.join(dynamic, "user_id").select("user_id", F.concat("static_text", F.lit("\n\n[RECENT_30_DAYS_HISTORY]\n"), "recent_text").alias("memory_text"))


def diagnosis_summary(nodes: Column, missing: Column) -> Column:
    return F.concat(F.lit("covers ["), F.array_join(F.slice(nodes, 1, 3), ", "), F.lit("], lacks ["), F.array_join(F.slice(missing, 1, 3), ", "), F.lit("]"))


def history_rows(answers: DataFrame) -> DataFrame:
    """Rows to append: response cut to 200 characters once."""
    return answers.select("user_id", "query", diagnosis_summary(F.col("related_nodes"), F.col("missing_prereqs")).alias("diagnosis_summary"), prefix(F.col("response"), 200).alias("response_summary"), F.col("missing_prereqs").alias("weak_topics_added"), "cost", "created_at")


def compaction_status(history: DataFrame, as_of: str) -> DataFrame:
    """user_id, old_count, needs_compression for users with old rows."""
    return old(history, as_of).groupBy("user_id").agg(F.count("*").alias("old_count")).withColumn("needs_compression", F.col("old_count") > STATUS_OVER)


def compactable(history: DataFrame, summaries: DataFrame, as_of: str, only_complete_quarters: bool = False) -> DataFrame:
    """Old rows of users with enough of them, in quarters without a summary, with their period."""
    rows = old(history, as_of).withColumn("period", period(F.col("created_at")))
    if only_complete_quarters:
        rows = rows.where(F.date_trunc("quarter", F.col("created_at")).cast("timestamp_ntz") + F.expr("INTERVAL 3 MONTHS") <= at(as_of) - F.expr(f"INTERVAL {OLD_DAYS} DAYS"))
    n = F.count("*").over(W.partitionBy("user_id"))
    return rows.withColumn("__n", n).where(F.col("__n") >= COMPACT_FROM).drop("__n").join(summaries.select("user_id", "period"), ["user_id", "period"], "left_anti")


def quarter_texts(rows: DataFrame) -> DataFrame:
    """user_id, period, compressed_count, source_text of compactable rows."""
    line = F.concat(F.lit("["), day_text(F.col("created_at")), F.lit("] "), F.coalesce("query", F.lit("")))
    return rows.withColumn("line", line).groupBy("user_id", "period").agg(F.count("*").alias("compressed_count"), ordered_text(F.struct("created_at", "id"), F.col("line")).alias("source_text"))


def summaries_of(quarters: DataFrame, summary: Column | None = None) -> DataFrame:
    """Summary rows; summary is the model's answer (a stand-in cuts the source). The ratio compares lengths in fours."""
    text = summary if summary is not None else prefix(F.col("source_text"), 200)
    made = quarters.withColumn("summary", text)
    ratio = F.concat(F.expr("length(source_text) div 4").cast("string"), F.lit(":"), F.expr("length(summary) div 4").cast("string"))
    return made.select("user_id", "period", "summary", "compressed_count", ratio.alias("compression_ratio"))


def compact(history: DataFrame, summaries: DataFrame, as_of: str, only_complete_quarters: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new summaries, history left, totals by user). The rewrite removes exactly the rows that were summarised, so it may run again."""
    rows = compactable(history, summaries, as_of, only_complete_quarters)
    made = summaries_of(quarter_texts(rows))
    left = history.join(rows.select("id"), "id", "left_anti")
    totals = rows.groupBy("user_id").agg(F.count("*").alias("n_rows"), F.round(F.sum("cost"), 2).alias("cost"), F.array_join(F.array_sort(F.collect_set("period")), ",").alias("periods"))
    return made, left, totals


def compact_if_needed(history: DataFrame, summaries: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The start-up job: compaction where the status of any user asks for it, else None."""
    if compaction_status(history, as_of).where("needs_compression").isEmpty():
        return None
    return compact(history, summaries, as_of)


def month_cost(history: DataFrame, month: str) -> DataFrame:
    """user_id, month_cost of a month YYYY-MM; null costs count as none."""
    start = F.lit(f"{month}-01").cast("timestamp_ntz")
    rows = history.where((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("INTERVAL 1 MONTH")))
    return rows.groupBy("user_id").agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("month_cost"))


def daily_stats(history: DataFrame) -> DataFrame:
    """day, active_users, total_queries, total_cost."""
    day = F.date_trunc("day", F.col("created_at")).cast("timestamp_ntz")
    return history.groupBy(day.alias("day")).agg(F.count_distinct("user_id").alias("active_users"), F.count("*").alias("total_queries"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("total_cost"))


def rolling_users(history: DataFrame, days: int = 30, lg_k: int = 12) -> DataFrame:
    """until, users, sketched, bound, n_days: distinct users of so many days up to each day that has rows.

    users is exact, from distinct (day, user). sketched merges daily sketches, which may be kept instead of the rows: a day
    is one row of some kilobytes however many users it has. bound is three standard errors (1.04 / sqrt(2**lg_k)).
    """
    day = F.to_date("created_at")
    reaches = F.expr(f"sequence(day, date_add(day, {days - 1}))")
    daily = history.where("user_id IS NOT NULL").groupBy(day.alias("day")).agg(F.hll_sketch_agg("user_id", F.lit(lg_k)).alias("sketch"))
    seen = daily.select("day")
    merged = daily.select(F.explode(reaches).alias("until"), "sketch").groupBy("until").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sketched"), F.count("*").alias("n_days"))
    exact = history.where("user_id IS NOT NULL").select(day.alias("day"), "user_id").distinct().select(F.explode(reaches).alias("until"), "user_id")
    exact = exact.join(F.broadcast(seen.select(F.col("day").alias("until"))), "until", "left_semi").groupBy("until").agg(F.count_distinct("user_id").alias("users"))  # a row a day
    bound = 3 * 1.04 / 2 ** (lg_k / 2)
    return exact.join(merged, "until").select("until", "users", "sketched", (F.col("users") * bound + 1).alias("bound"), "n_days")


def create_stats_view(history: DataFrame, name: str = "v_user_stats") -> None:
    """The daily figures as a view."""
    daily_stats(history).createOrReplaceTempView(name)


def running_totals(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with session_cost and session_queries so far."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("session_cost", F.round(F.sum("cost").over(w), 2)).withColumn("session_queries", F.count("*").over(w))


def mean_except_first(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, mean of value over all but the first row; 0 where there is none."""
    nr = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("__nr", nr).groupBy(key).agg(F.round(F.coalesce(F.avg(F.when(F.col("__nr") > 1, F.col(value))), F.lit(0.0)), 4).alias("mean_rest"))


def monotone(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, whether value never falls."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("__ok", F.coalesce(F.col(value) >= before, F.lit(True))).groupBy(key).agg(F.bool_and("__ok").alias("non_decreasing"))
