"""Connected components of a graph of any shape in few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

#: Two jumps a table: paths in a round's forest are seldom longer than a few nodes.
_JUMPS = 2


def _rooted(forest: DataFrame) -> DataFrame:
    """(node, up) with each node's root in place of its parent, by pointer jumping."""
    while True:
        step = forest
        for _ in range(_JUMPS):
            above = step.select(F.col("node").alias("up"), F.col("up").alias("beyond"))
            step = step.join(above, "up").select("node", F.col("beyond").alias("up"), F.col("up").alias("was"))
        made = written(step)
        dropped(forest.sparkSession, forest)
        forest = made.select("node", "up")
        if made.where("up <> was").isEmpty():
            return forest


def components(links: DataFrame, seen: list[int] | None = None) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach from each node that has one. seen: gets the open links of each round.

    In each round a node hangs itself under the neighbour with the least hash, if that is less than its own; trees become
    single nodes, and links inside them are gone. The hashes are of the round, so no order of names makes rounds many: of a
    chain about a third of the nodes is left after each. All tables but the result are cleared.
    """
    open_ = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    rounds: list[DataFrame] = []
    while n := open_.count():
        if seen is not None:
            seen.append(n)
        seed = F.lit(len(rounds))
        both = open_.union(open_.select("b", "a")).toDF("node", "other")
        near = both.groupBy("node").agg(F.min_by("other", F.xxhash64("other", seed)).alias("near"))
        up = F.when(F.xxhash64("near", seed) < F.xxhash64("node", seed), F.col("near")).otherwise(F.col("node"))
        roots = _rooted(written(near.select("node", up.alias("up"))))
        rounds.append(roots)
        ends = [roots.select(F.col("node").alias(c), F.col("up").alias(f"root_{c}")) for c in "ab"]
        moved = open_.join(ends[0], "a").join(ends[1], "b").where("root_a <> root_b")
        left = written(moved.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
        dropped(links.sparkSession, open_)
        open_ = left
    if not rounds:
        return open_.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # later rounds have fewer nodes, so they are put together from the last one on
    whole = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        whole = earlier.join(whole.select(F.col("node").alias("up"), F.col("up").alias("root")), "up", "left").select("node", F.coalesce("root", "up").alias("up"))
    whole = written(whole)
    least = whole.groupBy("up").agg(F.least(F.min("node"), F.min("up")).alias("component"))
    out = written(whole.join(least, "up").select("node", "component"))
    dropped(links.sparkSession, open_, whole, *rounds)
    return out
