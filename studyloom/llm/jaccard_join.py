"""N-gram Jaccard join by filtering under several global token orders.

A document's set holds its distinct word shingles, as 64-bit hashes. Equal sets are one class,
by a 128-bit signature, so copies cost nothing further. For a threshold t and a set of n tokens
any partner shares o = ceil(t * n) of them, so under *any* global order of tokens both have a
common one among their first n - o + 1: the prefix filter. It is applied four times.

1. Order by hash, with longer prefixes: among the first n - o + l tokens partners share l. Tokens
   found in one class only can't be shared, so a class with fewer than l others is out. Most
   classes end here, before anything but a fifth of the tokens has moved.
2. For the classes left tokens are counted. Order by count, then hash: rare tokens first, so
   frequent passages come last and rarely reach a prefix. Tokens of one class are skipped, but
   take their places. Classes that share a prefix token are paired, at their first common one
   only, if their sizes and the places of that token leave room for the overlap.
3. and 4. Two more orders, by coarser counts and other hashes: a pair must share a prefix token
   under each. Pairs that pass all filters are verified with the whole sets.

Verification runs in two rounds. First each prefix token pairs its classes with one pivot, the
class with the fewest rare tokens, which is linear in a group's size and joins most of a large group of near copies.
Then remaining pairs are formed only between different components. So links inside a component
need not all be found, but no link between components is missed: the components are exact.

Components are found by hooking to neighbours and pointer jumping, with each
round's tables in the shared folder.

Cases: null or empty text, or only white space: an empty set, linked with nothing, its component
its own doc_id; a null doc_id takes no part and has a null component; rows that share a doc_id
are one document in components, each with the n_shingles of its text; equal sets link however
short; an empty table gives no rows; other columns are ignored; doc_id is a whole number. 64-bit hashes stand for shingles:
two different ones in one document pair collide with a chance of about n * n / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, flagged, key_filter, read, rows_of
from .hashing import LOWER, NOT_SPACE, groups, mix, word_hashes, words

#: Overlap of at least NUM / DEN of the union, in shingles of SHINGLE words, for the query's contract.
SHINGLE, NUM, DEN = 3, 9, 10


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII capitals count as small."""
    for first, last, data, offsets in groups(texts):
        s, e = words(data, NOT_SPACE)
        h = word_hashes(LOWER[data], s, e)
        edges = np.searchsorted(s, offsets)
        rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            rolled = mix(rolled + h[k : len(h) - size + 1 + k] * np.uint64(2 * k + 3))
        for i in range(last - first):
            a, b = edges[i], edges[i + 1]
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                short = np.zeros(1, np.uint64)
                for k in range(b - a):
                    short = mix(short + h[a + k : a + k + 1] * np.uint64(2 * k + 3))
                yield mix(short + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


class _Sizes:
    """Prefix lengths for a set of n tokens, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n: int) -> int:
        return -(-n * self.num // self.den)

    def prefix(self, n: int) -> int:
        return n - self.overlap(n) + 1

    def shared(self, n: int) -> int:
        """Tokens that partners share among the first, longer(n)."""
        return min(self.prefix(n), self.overlap(n)) if n else 0

    def longer(self, n: int) -> int:
        return n - self.overlap(n) + self.shared(n)

    def needed(self, n: int) -> int:
        """Of them those that a class must share at least, as its smallest partner's prefix is shorter."""
        return self.shared(self.overlap(n))


def signatures(docs: DataFrame, size: int, sizes: _Sizes) -> DataFrame:
    """doc_id, n, s1, s2 (signature), first (the first tokens by hash, null for sets too small to differ from a partner)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("first", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, s1, s2, first = [], [], [], []
                for u in shingle_sets([t.encode() for t in batch.column(1).to_pylist()], size):
                    n.append(len(u))
                    s1.append(signature(u))
                    s2.append(int((mix(u ^ np.uint64(0xA5A5)).sum(dtype=np.uint64)).view(np.int64)))
                    first.append(u[: sizes.longer(len(u))].view(np.int64) if sizes.prefix(len(u)) > 1 or sizes.overlap(len(u) + 1) <= len(u) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(s1), pa.array(s2), pa.array(first, pa.list_(pa.int64()))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n int, s1 long, s2 long, first array<long>")


def signature(u: np.ndarray) -> int:
    return int(mix(mix(u).sum(dtype=np.uint64).reshape(1) + np.uint64(len(u)))[0].view(np.int64))


def _rare_counts(first: DataFrame) -> DataFrame:
    """s1, rare: of the first tokens of each class those that no other class has."""
    schema = pa.schema([("token", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one row for each token of a batch: a frequent token is aggregated before it moves
        for batch in batches:
            tokens = batch.column(1)
            length = np.diff(tokens.offsets.to_numpy())
            flat = tokens.flatten().to_numpy()
            of = np.repeat(batch.column(0).to_numpy(), length)
            order = np.lexsort((of, flat))
            flat, of = flat[order], of[order]
            start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, int)
            end = np.append(start[1:], len(flat)) - 1 if len(flat) else start
            yield pa.RecordBatch.from_arrays([pa.array(flat[start]), pa.array(of[start]), pa.array(of[end])], schema=schema)

    dealt = first.mapInArrow(run, "token long, lo long, hi long").repartition("token")
    held = dealt.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return held.where("lo = hi").groupBy(F.col("lo").alias("s1")).agg(F.count("*").cast("int").alias("rare"))


def _whole_sets(docs: DataFrame, alive: DataFrame, size: int) -> DataFrame:
    """rep, n, tokens of the classes of alive (rep, s1), read again from one document each."""
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets([t.encode() for t in batch.column(2).to_pylist()], size), strict=True)
                own = [(r, u) for r, s, u in rows if signature(u) == s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _ in own], pa.int64()), pa.array([len(u) for _, u in own], pa.int32()), pa.array([u.view(np.int64) for _, u in own], pa.list_(pa.int64()))], schema=schema
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    rows = flagged(rows, key_filter(alive, "rep"), F.col("rep")).where("__may")  # the other texts needn't be shuffled
    return rows.join(alive.select("rep", "s1").hint("shuffle_hash"), "rep").select("rep", "s1", "text").mapInArrow(run, "rep long, n int, tokens array<long>")


def _prefixes(sets: DataFrame, n_prefix: Column, keep: Scratch) -> DataFrame:
    """rep, n, rare, p1, p2, p3: prefixes under three orders, without the tokens of one class only."""
    rows = sets.select("rep", "n", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("c"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("token", "c")
    counts = keep.save(counts, "counts")  # a plain table, so that the join can split a hot token
    shared = rows.join(counts, "token").groupBy("rep", "n").agg(F.collect_list(F.struct("c", "token")).alias("ts"))
    shared = shared.withColumn("rare", F.col("n") - F.size("ts")).withColumn("left", n_prefix - F.col("rare")).where("left > 0")

    def order(key) -> Column:
        return F.transform(F.slice(F.array_sort(F.transform("ts", key)), F.lit(1), F.col("left")), lambda x: x["token"])

    return shared.select(
        "rep", "n", "rare",
        order(lambda x: F.struct(x["c"].alias("c"), x["token"].alias("token"))).alias("p1"),
        order(lambda x: F.struct(F.floor(F.log2(x["c"].cast("double"))).alias("c"), F.xxhash64(x["token"]).alias("h"), x["token"].alias("token"))).alias("p2"),
        order(lambda x: F.struct(F.floor(F.log2(x["c"].cast("double")) / 3).alias("c"), F.xxhash64(x["token"], F.lit(1)).alias("h"), x["token"].alias("token"))).alias("p3"),
    )


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets reach the threshold."""
    mine, other = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(mine, "a").join(other, "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(den * common >= num * (F.size("ta") + F.size("tb") - common)).select("a", "b")


def components(edges: DataFrame, keep: Scratch, name: str) -> DataFrame:
    """node, label: the smallest node that edges (a, b) reach from each node, for nodes that have edges.

    In each round every node hooks to the neighbour of the least hash, if that is less than its own, and all nodes of
    such a tree become its root; edges inside trees are gone. Hashes differ by round, so no order of ids makes long
    trees or many rounds: a third of a chain's nodes are left after each. Roots are renamed to their smallest node at the end.
    """
    open_ = keep.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-edges-0")
    rounds, maps = 0, []
    while not open_.isEmpty():
        seed = F.lit(rounds)
        both = open_.select("a", "b").union(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", F.xxhash64("b", seed)).alias("near"))
        up = F.xxhash64("near", seed) < F.xxhash64("node", seed)
        tree = keep.save(near.select("node", F.when(up, F.col("near")).otherwise(F.col("node")).alias("up")), f"{name}-tree-{rounds}-0")
        jumps = 0
        while True:  # pointer jumping; trees are seldom deeper than a few nodes
            jumps += 1
            above = tree.select(F.col("node").alias("up"), F.col("up").alias("above"))
            tree = tree.join(above, "up").select("node", F.col("above").alias("up"), F.col("up").alias("was"))
            if jumps % 2 == 0:  # two jumps a table
                tree = keep.save(tree, f"{name}-tree-{rounds}-{jumps}")
                keep.drop(f"{name}-tree-{rounds}-{jumps - 2}")
                if tree.where("up <> was").isEmpty():
                    break
            tree = tree.select("node", "up")
        roots = tree.select("node", "up")
        maps.append(roots)
        of_a, of_b = (roots.select(F.col("node").alias(c), F.col("up").alias(f"r{c}")) for c in "ab")
        moved = open_.join(of_a, "a").join(of_b, "b").where("ra <> rb")
        open_ = keep.save(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges-{rounds + 1}")
        keep.drop(f"{name}-edges-{rounds}")
        rounds += 1
    if not maps:
        return open_.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # the rounds' tables shrink, so they are put together from the last one on
    whole = maps.pop()
    while maps:
        later = whole.select(F.col("node").alias("up"), F.col("up").alias("root"))
        whole = maps.pop().join(later, "up", "left").select("node", F.coalesce("root", "up").alias("up"))
    whole = keep.save(whole, f"{name}-roots")
    least = whole.groupBy("up").agg(F.least(F.min("node"), F.min("up")).alias("label"))
    return keep.save(whole.join(keep.save(least, f"{name}-least"), "up").select("node", "label"), f"{name}-labels")


def _with_label(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs between different components only."""
    if labels is None:
        return pairs
    one, two = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(one, "a", "left").join(two, "b", "left").where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")


def join(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: components of the links of at least num / den."""
    keep, sizes = Scratch(spark), _Sizes(num, den)
    # lengths by set size, as expressions of whole numbers
    n = F.col("n").cast("long")

    def overlap(x: Column) -> Column:
        return F.floor((x * num + (den - 1)) / F.lit(den))

    def prefix(x: Column) -> Column:
        return x - overlap(x) + 1

    def shared(x: Column) -> Column:
        return F.least(prefix(x), overlap(x))

    signed = keep.save(signatures(docs, size, sizes), "signed")
    classes = signed.where("doc_id IS NOT NULL AND n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    classes = keep.save(classes, "classes")
    rare = _rare_counts(signed.where("doc_id IS NOT NULL AND first IS NOT NULL").select("s1", "first"))
    longer = n - overlap(n) + shared(n)
    alive = classes.join(rare, "s1", "left").where(longer - F.coalesce("rare", F.lit(0)) >= shared(overlap(n))).select("rep", "s1", "n")
    alive = keep.save(alive, "alive")
    sets = keep.save(_whole_sets(docs, alive, size), "sets")
    prefixes = keep.save(_prefixes(sets, prefix(n).cast("int"), keep), "prefixes")
    postings = prefixes.select("rep", "n", "rare", "p1", F.posexplode("p1").alias("pos", "token"))

    # round 1: a token's classes against its pivot
    fewest = F.shiftleft(F.col("rare").cast("long"), 31) + F.pmod(F.xxhash64("rep"), F.lit(1 << 31))
    pivots = keep.save(postings.groupBy("token").agg(F.min_by("rep", fewest).alias("pivot")), "pivots")
    first_pairs = postings.select("token", "rep").join(pivots, "token").where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    room = _room(num, den)
    ends = prefixes.select("rep", "n", "p2", "p3")

    def filtered(pairs: DataFrame) -> DataFrame:
        """Intersection of the filters: sizes, and a common prefix token under the other orders."""
        x = ends.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("p2").alias("p2a"), F.col("p3").alias("p3a"))
        y = ends.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("p2").alias("p2b"), F.col("p3").alias("p3b"))
        both = pairs.join(x, "a").join(y, "b")
        fits = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
        return both.where(fits & F.arrays_overlap("p2a", "p2b") & F.arrays_overlap("p3a", "p3b")).select("a", "b")

    links = keep.save(_verified(filtered(first_pairs), sets, num, den), "links-1")
    labels = components(links, keep, "part")

    # round 2: all pairs that are left between components
    labelled = postings.join(labels, postings["rep"] == labels["node"], "left").withColumn("label", F.coalesce("label", "rep")).drop("node")
    # a token whose classes are all in one component has nothing left to compare
    open_tokens = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    open_tokens = keep.save(open_tokens, "open")
    labelled = keep.save(labelled.join(open_tokens, "token", "left_semi"), "labelled")
    x, y = (labelled.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "rare", "p1", "pos", "label")]) for s in "xy")
    meet = (F.col("label_x") != F.col("label_y")) & (F.col("rep_x") < F.col("rep_y")) & room
    first_common = F.element_at(F.array_intersect("p1_x", "p1_y"), 1) == F.col("token_x")
    pairs = x.withColumnRenamed("token", "token_x").join(y.withColumnRenamed("token", "token_y"), (F.col("token_x") == F.col("token_y")) & meet & first_common)
    pairs = keep.save(pairs.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")), "pairs")
    more = keep.save(_verified(filtered(pairs), sets, num, den), "links-2")
    # the first round's components stand for its links
    final = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more), keep, "all")

    keep.drop("alive", "sets", "counts", "prefixes", "pivots", "open", "labelled", "pairs", "links-1", "links-2", "part-labels")
    named = classes.join(final, classes["rep"] == final["node"], "left").select("s1", "s2", "n", F.coalesce("label", "rep").alias("component"))
    # two classes may share a doc_id where rows repeat it
    out = signed.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.cast("long").alias("component_id"))


def _room(num: int, den: int) -> Column:
    """Sizes and the places of a first common token leave room for the overlap num / (num + den) of both sizes."""
    nx, ny = F.col("n_x"), F.col("n_y")
    fits = (nx * den >= ny * num) & (ny * den >= nx * num)
    most = F.least(nx - F.col("rare_x") - F.col("pos_x"), ny - F.col("rare_y") - F.col("pos_y"))
    return fits & (most * (num + den) >= num * (nx + ny))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One document of each component: that of the smallest doc_id; of equal rows one. Rows with null doc_id stay, columns of any names pass through."""
    keep = Scratch(spark)
    found = keep.save(join(spark, docs, size, num, den).select("doc_id", "component_id").where("doc_id IS NOT NULL"), "found")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__doc")).distinct()
    repeated = found.groupBy(F.col("doc_id").alias("__doc")).agg(F.count("*").alias("n")).where("n > 1").select("__doc")
    touched = keep.save(gone.withColumn("__gone", F.lit(True)).unionByName(repeated.withColumn("__gone", F.lit(False))), "touched")
    # documents that surely stay, once, aren't shuffled
    rows = rows_of(docs, F.col("doc_id").cast("long").alias("__id"))
    split = flagged(rows, key_filter(touched, "__doc"), F.col("__id"))
    near = split.where("__may AND __id IS NOT NULL")
    near = near.join(touched.where("__gone").hint("shuffle_hash"), F.col("__id") == F.col("__doc"), "left_anti").select("__row").dropDuplicates()
    return split.where("NOT __may OR __id IS NULL").select("__row").unionByName(near).select("__row.*")
