"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at one aspect of a text and votes bad (0), abstains (1) or votes good (2); every
fault is seen by several rules, and most rules are wrong at times. The model has the share of good
texts and for each rule how often its vote is bad on bad texts and on good ones. Expectation-
maximisation estimates these from the counts of vote patterns over all documents (at most 3 to the
number of rules, whatever the corpus size), starting from the majority of votes. The posterior
probability of good decides: a bad vote of a rule that often votes so on good texts is outvoted, one
of a rule that hardly does rejects a text against many good votes of rules that don't see its fault.

The estimation is one ``aggregate`` expression over the row that holds the pattern counts; the
table of pattern posteriors, of the same bounded size, is broadcast to the documents.

Measures, with words ``[^\\x20\\x09-\\x0D]+``: n_words; word_chars; n_symbols; n_dup_lines;
n_repeat_words. Repeated 5-word windows are sought by hash; where hashes meet, the windows'
words are compared.

Cases: a null or empty text has no words and fails the base rule (n_words < 10); ties of the
posterior (exactly 0.5) are kept; repeated rows get equal verdicts and each counts as evidence;
an empty table gives no rows; other columns are ignored by ``assess`` and pass through ``stage``
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, words_of

WINDOW = 5
ITERATIONS = 40
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(docs: DataFrame) -> DataFrame:
    """Measures of each row of docs (columns id..., text); keeps all columns but text."""
    other = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    step = docs.select(
        *other,
        words_of(text).alias("words"),
        lines.alias("lines"),
        F.length(text).alias("n_chars_all"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count(text, F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")).alias("n_stops"),
        F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D]")).alias("n_marks"),
    )
    step = step.select(
        *other, "words", "n_symbols", "n_upper", "n_stops", "n_marks",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.when(
        F.col("n_words") > WINDOW,
        F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])),
    )
    step = step.withColumn("windows", windows)
    step = step.withColumn("clash", F.size("windows") > F.size(F.array_distinct("windows")))
    return step.select(
        *other, *MEASURES[:-1], "n_upper", "n_stops", "n_marks", "n_lines",
        F.when(F.coalesce("clash", F.lit(False)), _covered("words", "windows")).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("hashes")).alias("n_distinct"),
        F.size(F.filter("hashes", lambda h, i: (i > 0) & (h == F.get("hashes", F.greatest(i - 1, F.lit(0)))))).alias("n_same"),
    )


def _covered(words: str, windows: str) -> Column:
    """Words that lie in windows which occur twice or more."""
    # (hash, window, position) sorted: equal windows are neighbours; the words are compared, not the hashes alone
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i"))))

    def repeated(a: Column) -> Column:
        def at(k: Column) -> Column:
            return F.get(a, k)

        same = F.filter(a, lambda x, k: (x["w"] == F.coalesce(at(k - 1)["w"], F.lit(""))) | (x["w"] == F.coalesce(at(k + 1)["w"], F.lit(""))))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    positions = F.transform(F.array(placed), repeated)
    added = F.transform(positions, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), x + WINDOW) - x)), F.lit(0), lambda s, x: s + x))
    return F.get(added, F.lit(0))


def rules() -> dict[str, Column]:
    """Votes by rule: 0 bad, 1 abstain, 2 good. Each has a range that it calls good and one that it calls bad, and abstains between."""
    n, chars, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    long_enough = F.col("n_words") >= 20

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 2).otherwise(1)

    # the words of a text repeat the more, the longer it is
    varied = F.col("n_distinct") / F.least(n, F.lit(300))
    length = chars / n
    return {
        "windows": vote(F.col("n_repeat_words") > 0.15 * n, long_enough & (F.col("n_repeat_words") == 0)),
        "neighbours": vote(F.col("n_same") > 0.1 * n, long_enough & (F.col("n_same") <= 0.02 * n)),
        "variety": vote(long_enough & (varied < 0.3), long_enough & (varied > 0.55)),
        "symbols": vote(F.col("n_symbols") > 0.15 * n, F.col("n_symbols") <= 0.02 * n),
        "marks": vote(long_enough & (F.col("n_marks") > 0.5 * n), F.col("n_marks") <= 0.35 * n),
        "word_length": vote(long_enough & ((length > 6.3) | (length < 3.5)), length.between(4.2, 5.9)),
        "capitals": vote(F.col("n_upper") > 0.3 * chars, F.col("n_upper") <= 0.08 * chars),
        "stops": vote(long_enough & ((F.col("n_stops") > 0.3 * n) | (F.col("n_stops") < 0.03 * n)), F.col("n_stops").between(0.05 * n, 0.2 * n)),
        "lines": vote((lines >= 3) & (F.col("n_dup_lines") > 0.2 * lines), (lines >= 3) & (F.col("n_dup_lines") == 0)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_votes(measured: DataFrame) -> DataFrame:
    named = rules()
    code = F.lit(0)
    for v in named.values():
        code = code * 3 + v
    return measured.withColumn("__pattern", code.cast("int"))


def posteriors(patterns: DataFrame, n_rules: int, iterations: int = ITERATIONS) -> DataFrame:
    """(__pattern, posterior) for each pattern of patterns (__pattern, n): the EM fit. At most 3**n_rules rows."""
    m = n_rules
    digits = ", ".join(f"cast(pmod(floor(__pattern / {3 ** (m - 1 - j)}), 3) as int)" for j in range(m))
    one = patterns.selectExpr("__pattern", f"array({digits}) AS v", "cast(n AS double) AS n")
    one = one.agg(F.sort_array(F.collect_list(F.struct("__pattern", "v", "n"))).alias("pats"))
    # state: log-odds of good before any vote, and what a bad or a good vote of each rule adds; an abstention says nothing
    odds = f"1 / (1 + exp(-aggregate(sequence(0, {m - 1}), s.c, (a, j) -> a + CASE p.v[j] WHEN 0 THEN s.bad[j] WHEN 2 THEN s.good[j] ELSE 0D END)))"
    start = "aggregate(p.v, 0.5D, (a, x) -> a + x - 1) / (1 + aggregate(p.v, 0D, (a, x) -> a + abs(x - 1))) / 2 + 0.5D"

    def total(what: str) -> str:
        return f"aggregate(q, 0D, (a, p) -> a + {what})"

    def of_rule(share: str, prior: str, of: str) -> str:
        """How often votes are bad among texts of one class, drawn to a few made-up votes."""
        return f"transform(sequence(0, {m - 1}), c -> ({prior} + {total(f'IF(p.v[c] = 0, p.n * {share}, 0D)')}) / ({of} + {total(f'IF(p.v[c] <> 1, p.n * {share}, 0D)')}))"

    good = f"(9 + {total('p.n * p.g')}) / (10 + {total('p.n')})"
    maximise = (
        "transform(array(transform(pats, p -> struct(p.v AS v, p.n AS n, {g} AS g))), q -> "
        f"transform(array(struct({good} AS g, {of_rule('(1 - p.g)', '5D', '10D')} AS a, {of_rule('p.g', '0.5D', '10D')} AS b)), r -> struct("
        # a rule's bad vote never speaks for good, nor its good vote for bad
        "ln(r.g / (1 - r.g)) AS c, zip_with(r.a, r.b, (a, b) -> least(ln(b / a), 0D)) AS bad, zip_with(r.a, r.b, (a, b) -> greatest(ln((1 - b) / (1 - a)), 0D)) AS good))[0])[0]"
    )
    fit = f"aggregate(sequence(1, {iterations}), {maximise.replace('{g}', start)}, (s, t) -> {maximise.replace('{g}', odds)})"
    fitted = one.selectExpr("pats", f"{fit} AS s")
    return fitted.selectExpr(f"inline(transform(pats, p -> struct(p.__pattern AS __pattern, {odds} AS posterior)))")


def judge(voted: DataFrame, patterns: DataFrame) -> DataFrame:
    """voted with base_failed, posterior and kept."""
    post = posteriors(patterns, len(rules()))
    out = voted.join(F.broadcast(post), "__pattern")  # at most 3**9 = 19,683 rows
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def assess(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, posterior, kept of each row."""
    voted = Scratch(spark).save(with_votes(measures(docs.select("doc_id", "text"))), "votes")
    return judge(voted, voted.groupBy("__pattern").agg(F.count("*").alias("n"))).select("doc_id", *MEASURES, "base_failed", "kept", "posterior")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark, read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents kept, with all their columns, whatever their names; a null text goes, as it fails the base rule.

    Rows are written once with the number of their vote pattern, so texts are measured once and no join on doc_id moves
    them; the join with the patterns that are kept is the filter.
    """
    keep = Scratch(spark)
    rows = with_votes(measures(docs.select(F.struct("*").alias("__row"), "text")))
    rows = keep.save(rows.select("__row", "__pattern", base_failed().alias("__failed")), "rows")
    post = posteriors(rows.groupBy("__pattern").agg(F.count("*").alias("n")), len(rules()))
    kept = keep.save(post.where("posterior >= 0.5").select("__pattern"), "kept")
    return rows.where("NOT __failed").join(F.broadcast(kept), "__pattern").select("__row.*")
