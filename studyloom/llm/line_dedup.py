"""Line dedup by content-defined line chunks, in DataFrame functions only.

Only lines with a word count. Two that follow each other are a pair, known by the hashes of both
and the lines between. Pairs that occur once in the corpus are borders, so a passage that
documents share, of two lines or more, is a run of its own wherever it stands. A pair that is
rarer than a neighbour in its run is a border too, so a passage that is part of a longer one is cut
out of it; and inside long runs a hash of the pair that is divisible by ``AVERAGE`` is one, at least
``LEAST_LINES`` lines from the run's ends, so that runs that share a part only have equal chunks.
Chunks are grouped by digest over the whole corpus. Where a digest
occurs more than once the chunks' bytes are compared: occurrences are grouped by the text
itself. The occurrence in the smallest doc_id, and there the first, stays; the others are removed.

Only hashes of pairs, not texts, are grouped for all lines; texts move where a pair repeats, behind
a bitmap of bounded size, and whole documents only where a pair repeats. Counts are aggregated
before each shuffle, so a pair that a third of all documents hold is a row a task.

Cases: null text counts as empty; a text without a repeated pair of lines stays as it is;
lines are separated by newline only and keep their other bytes; chunks need ``LEAST_LINES``
lines with a word, so blank lines are never removed for themselves, and a repeated line between
lines that don't repeat with it stays; rows that share a doc_id are
one document when the first holder is sought, so a chunk stays in each row of the smallest doc_id;
rows with null doc_id stay as they are and lend nothing; an empty table gives no rows; other columns pass
through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, flagged, key_filter, read, rows_of

AVERAGE, LEAST_LINES = 3, 2

#: Characters that a blank line may hold.
BLANK = " \t\x0b\f\r"


def _lined(docs: DataFrame, text: str) -> DataFrame:
    """docs with __lines and __at: numbers of the lines with a word."""
    step = docs.withColumn("__lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    return step.withColumn("__at", F.filter(F.transform("__lines", lambda x, i: F.when(F.btrim(x, F.lit(BLANK)) != "", i)), lambda i: i.isNotNull()))


def _pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """__doc, __of (text hash), k, pair: hash of the lines k and k + 1 with a word and their distance, of each document."""
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__doc"), F.xxhash64(text).alias("__of"), F.col(text).alias("__text"))
    own = _lined(own, "__text").withColumn("__hashes", F.transform("__at", lambda i: F.xxhash64(F.get("__lines", i))))

    def pair(i: Column, k: Column) -> Column:
        return F.xxhash64(F.get("__hashes", k), F.get("__hashes", k + 1), F.get("__at", k + 1) - i)

    of_two = F.transform(F.expr("slice(__at, 1, greatest(size(__at) - 1, 0))"), pair)
    return own.select("__doc", "__of", F.posexplode(of_two).alias("k", "pair"))


def marks(docs: DataFrame, keep: Scratch | None = None) -> DataFrame:
    """__doc, __of, __marks: by document the sorted (k, n, pair) of its pairs that occur n > 1 times in the corpus."""
    pairs = _pairs(docs)
    again = pairs.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1")
    if keep is not None:
        again = keep.save(again, "again")
        pairs = flagged(pairs, key_filter(again, "pair"), F.col("pair")).where("__may").drop("__may")
    held = pairs.join(again.hint("shuffle_hash"), "pair").groupBy("__doc", "__of")
    return held.agg(F.sort_array(F.collect_set(F.struct("k", "n", "pair"))).alias("__marks"))


def _cut(docs: DataFrame, text: str) -> DataFrame:
    """docs (with __marks) with __lines and __chunks: array of (first, n, digest), digest null unless the chunk may be removed."""
    step = _lined(docs, text)

    def near(name: str, j: Column, d: int) -> Column:
        """The mark before or after, null unless it is of the adjoining pair."""
        other = F.when(j + d >= 0, F.get(name, j + d))
        return F.when(other["k"] == F.get(name, j)["k"] + d, other)

    def common(m: Column, j: Column) -> Column:
        most = F.greatest(near("__marks", j, -1)["n"], near("__marks", j, 1)["n"])
        return F.coalesce(most, F.lit(0)) <= m["n"]

    step = step.withColumn("__marks", F.coalesce("__marks", F.expr("cast(array() as array<struct<k:int,n:bigint,pair:bigint>>)")))
    step = step.withColumn("__inner", F.filter("__marks", common))

    def hit(m: Column) -> Column:
        return F.pmod(F.xxhash64(m["pair"]), F.lit(AVERAGE)) == 0

    def kind(m: Column, j: Column) -> Column:
        before, after = near("__inner", j, -1), near("__inner", j, 1)
        inside = before.isNotNull() & after.isNotNull() & hit(m) & ~F.coalesce(hit(before), F.lit(False))
        # line numbers of the run's or chunk's first and last line
        first = F.when(before.isNull(), F.get("__at", m["k"])).when(inside, F.get("__at", m["k"] + 1))
        last = F.when(after.isNull(), F.get("__at", m["k"] + 1)).when(inside, F.get("__at", m["k"]))
        return F.struct(first.alias("first"), last.alias("last"))

    step = step.withColumn("__ends", F.transform("__inner", kind))
    step = step.withColumn("__firsts", F.filter(F.transform("__ends", lambda e: e["first"]), lambda x: x.isNotNull()))
    step = step.withColumn("__lasts", F.filter(F.transform("__ends", lambda e: e["last"]), lambda x: x.isNotNull()))

    # the lines between runs are chunks too
    def span(first: Column, end: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), (end - first).cast("int").alias("n"))

    def since(j: Column) -> Column:
        return F.when(j > 0, F.get("__lasts", j - 1) + 1).otherwise(0)

    inner = F.flatten(F.transform("__firsts", lambda f, j: F.array(span(since(j), f), span(f, F.get("__lasts", j) + 1))))
    tail = span(since(F.size("__firsts")), F.size("__lines"))
    step = step.withColumn("__spans", F.filter(F.concat(inner, F.array(tail)), lambda c: c["n"] > 0))

    def chunk(c: Column) -> Column:
        lines = F.slice("__lines", c["first"] + 1, c["n"])
        wordy = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(BLANK)) != ""))
        return F.struct(c["first"].alias("first"), c["n"].alias("n"), F.when(wordy >= LEAST_LINES, F.xxhash64(lines)).alias("digest"))

    step = step.withColumn("__chunks", F.transform("__spans", chunk))
    return step.drop("__marks", "__inner", "__ends", "__firsts", "__lasts", "__spans", "__at")


def chunked(docs: DataFrame) -> DataFrame:
    """docs with __lines and __chunks: array of (first, n, digest), digest null unless the chunk may be removed."""
    found = marks(docs)
    both = docs.join(found, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__of")), "left").drop("__doc", "__of")
    return _cut(both, "text")


def _place(c: Column) -> Column:
    """First line and number of lines as one number."""
    return c["first"].cast("long") * (1 << 32) + c["n"]


def removals(docs: DataFrame, keep: Scratch) -> DataFrame:
    """__doc, __of, __chunks, __removed: by document with a repeated pair (doc_id and text hash) the places of its chunks, and of those that go."""
    found = keep.save(marks(docs, keep), "marks")
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    own = flagged(own, key_filter(found, "__doc"), F.col("__id")).where("__may")
    own = own.join(found.hint("shuffle_hash"), (F.col("__id") == F.col("__doc")) & (F.xxhash64("__text") == F.col("__of"))).select("__doc", "__of", "__text", "__marks")
    text = F.transform("__chunks", lambda c: F.struct(_place(c).alias("place"), c["digest"].alias("digest"), F.when(c["digest"].isNotNull(), F.array_join(F.slice("__lines", c["first"] + 1, c["n"]), "\n")).alias("bytes")))
    cut = keep.save(_cut(own, "__text").select("__doc", "__of", text.alias("__chunks")), "cut")
    rows = cut.select("__doc", "__of", F.explode("__chunks").alias("c")).select("__doc", "__of", "c.*").where("digest IS NOT NULL")
    twice = keep.save(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "twice")
    texts = flagged(rows, key_filter(twice, "digest"), F.col("digest")).where("__may").drop("__may")
    texts = keep.save(texts.join(twice.hint("shuffle_hash"), "digest", "left_semi"), "texts")
    same = texts.groupBy("digest", "bytes").agg(F.min("__doc").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a plain table, and its rows dealt by document next, so that the join can split a chunk that very many documents hold
    same = keep.save(same, "same")
    held = texts.join(same, ["digest", "bytes"]).repartition("__doc", "__of").groupBy("digest", "bytes", "keeper", "__doc", "__of").agg(F.sort_array(F.collect_set("place")).alias("places"))
    # the keeper's first occurrence stays
    gone = held.select("__doc", "__of", F.explode(F.when(F.col("keeper") == F.col("__doc"), F.expr("slice(places, 2, size(places))")).otherwise(F.col("places"))).alias("place"))
    gone = gone.groupBy("__doc", "__of").agg(F.collect_set("place").alias("__removed"))
    places = cut.select("__doc", "__of", F.transform("__chunks", lambda c: c["place"]).alias("__chunks")).distinct()
    return places.join(gone, ["__doc", "__of"], "left")


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of each row __row (all columns of docs), __new (the text without repeated chunks), __removed (places, first line * 2**32 + lines, of the chunks that went), __n_lines, __n_chunks."""
    keep = Scratch(spark)
    gone = keep.save(removals(docs.select("doc_id", "text"), keep), "gone")
    keep.drop("again", "texts", "twice", "same", "cut", "marks")
    # texts without a repeated pair, one chunk each, aren't shuffled
    rows = rows_of(docs, F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    split = flagged(rows, key_filter(gone, "__doc"), F.col("__id"))
    changed = split.where("__may").drop("__may").join(gone.hint("shuffle_hash"), (F.col("__id") == F.col("__doc")) & (F.xxhash64("__text") == F.col("__of")), "left")
    none = F.lit(None).cast("array<bigint>")
    changed = changed.select("__row", "__text", "__chunks", "__removed").unionByName(split.where("NOT __may").select("__row", "__text", none.alias("__chunks"), none.alias("__removed")))
    joined = changed.withColumn("__removed", F.coalesce("__removed", F.expr("cast(array() as array<bigint>)")))
    joined = joined.withColumn("__lines", F.split(F.coalesce("__text", F.lit("")), "\n", -1)).withColumn("__n_chunks", F.when(F.col("__chunks").isNull(), 1).otherwise(F.size("__chunks")))
    kept = F.array_except("__chunks", F.col("__removed"))
    lines = F.transform(kept, lambda p: F.array_join(F.slice("__lines", F.shiftright(p, 32).cast("int") + 1, p.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")), "\n"))
    text = F.when(F.size("__removed") == 0, F.col("__text")).otherwise(F.array_join(lines, "\n"))
    return joined.select("__row", text.alias("__new"), "__removed", F.size("__lines").alias("__n_lines"), "__n_chunks")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, removed (first:lines, comma-joined), text."""
    out = dedup(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform(F.sort_array("__removed"), lambda p: F.concat_ws(":", F.shiftright(p, 32).cast("string"), p.bitwiseAND(F.lit((1 << 32) - 1)).cast("string"))), ",")
    return out.select(
        "__row.doc_id",
        F.col("__n_lines").cast("long").alias("n_lines"),
        F.col("__n_chunks").cast("long").alias("n_chunks"),
        F.size("__removed").cast("long").alias("n_removed_chunks"),
        F.aggregate("__removed", F.lit(0).cast("long"), lambda s, p: s + p.bitwiseAND(F.lit((1 << 32) - 1))).alias("n_removed_lines"),
        spans.alias("removed"),
        F.coalesce("__new", F.lit("")).alias("text"),
    )


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without repeated chunks; n_chars follows the text, columns of any names pass through."""
    out = dedup(spark, docs)
    n_chars = F.when(F.size("__removed") > 0, F.length("__new").cast("long")).otherwise(F.col("__row.n_chars"))
    row = F.col("__row").withField("text", F.col("__new"))
    return out.select((row.withField("n_chars", n_chars) if "n_chars" in docs.columns else row).alias("__row")).select("__row.*")
