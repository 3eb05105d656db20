"""Phrases of two and three words that occur together more often than their parts do, counted in counting quotient filters.

Words get ids of ``ID_BITS`` bits from a hash of language and word; the few that share an id with a
frequent word get one from a reserved range, so ids tell words apart. The ids of a phrase are packed
into two halves and permuted by an invertible Feistel network, so the result spreads evenly and loses
nothing. Its top bits are the quotient: they name a block and a slot there, which is where an entry stands and
is not written. What is written is the full remainder and a counter of one byte, longer where it must be.
Each task sorts its phrases into such filters; a block's filters of all tasks, which are sorted,
are merged in one task, equal remainders' counters are added, and what is frequent is turned
back into ids. Blocks are as many as the number of words asks for, so each stays small, and
a phrase takes one entry a task however often it occurs.

Words come first, then pairs of frequent words, then triples whose pairs are both frequent. What is
frequent goes to the tasks as a bitmap of at most ``MOST_BITS`` bits: past some millions of
keys it lets more phrases into the filters, but the counts stay exact.

Scores are whole numbers of 38 digits until they are divided. Hashes of words are compared with
the words' bytes in each task, and over the corpus; if two words had the same one, the run
would end with an error rather than with mixed counts.

Cases: null text is empty, null lang is ``und`` (rows of that lang join it); a doc_id isn't needed
and may repeat, each row counts; other columns are ignored; an empty table, or one without phrases
that occur often enough, gives no rows. A task holds a megabyte of text (or one longer text) and at most
``HELD`` phrases and ``HELD_WORDS`` words besides that.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read
from .hashing import LOWER, groups, mix, ranges, word_hashes, words

#: Candidates occur so often; a longer candidate with so many of 100 of its occurrences drops a phrase; rows kept of each language.
LEAST, COVERED, TOP = 10, 50, 2000
ID_BITS = 42
#: Ids from here on are given to words that would share one.
RESERVED = (1 << ID_BITS) - (1 << 20)
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
HELD, HELD_WORDS = 1 << 21, 1 << 17
#: Words of the corpus for each block of the filters, and the fewest blocks (bits).
PER_BLOCK, LEAST_BLOCK_BITS = 1 << 18, 9

_MARK = np.zeros(256, bool)
_MARK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_MARK
_WORD[[0x20, 0x09]] = False
_ROUND = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9)]


def permute(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of pairs of halves of so many bits."""
    mask = np.uint64((1 << bits) - 1)
    for k in range(0, 4, 2):
        a = a ^ (mix(b + _ROUND[k]) & mask)
        b = b ^ (mix(a + _ROUND[k + 1]) & mask)
    return a, b


def restore(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """permute undone."""
    mask = np.uint64((1 << bits) - 1)
    for k in (2, 0):
        b = b ^ (mix(a + _ROUND[k + 1]) & mask)
        a = a ^ (mix(b + _ROUND[k]) & mask)
    return a, b


def pack(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Two or three ids as halves, and the halves' bits."""
    if len(ids) == 2:
        return ids[0], ids[1], ID_BITS
    half = np.uint64(ID_BITS // 2)
    low = np.uint64((1 << (ID_BITS // 2)) - 1)
    return ids[0] << half | ids[1] >> half, (ids[1] & low) << np.uint64(ID_BITS) | ids[2], ID_BITS * 3 // 2


def unpack(a: np.ndarray, b: np.ndarray, size: int) -> list[np.ndarray]:
    if size == 2:
        return [a, b]
    half, low = np.uint64(ID_BITS // 2), np.uint64((1 << (ID_BITS // 2)) - 1)
    return [a >> half, (a & low) << half | b >> np.uint64(ID_BITS), b & np.uint64((1 << ID_BITS) - 1)]


def counted(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (a, b) with the sums of their counters (1 each where none are given)."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    sums = np.diff(np.append(start, len(a))) if n is None else np.add.reduceat(n[order], start) if len(a) else np.zeros(0, np.int64)
    return a[start], b[start], sums


def _low_bytes(x: np.ndarray, bits: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].tobytes()


def _from_bytes(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    width = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8").ravel().astype(np.uint64), at + n * width


_HEAD = struct.Struct("<BIII")


def to_filter(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: int, block_bits: int) -> bytes:
    """The filter of a block: sorted entries, whose halves have so many bits; the block's own bits are left out.

    Slots take about four entries. Each slot has the number of its entries; the remainders stand in order. Counters from
    255 on have 255 in their byte and stand at the end.
    """
    slot_bits = max(0, min(len(a).bit_length() - 3, 16))
    left = bits - block_bits - slot_bits
    quotient = (a >> np.uint64(left)) & np.uint64((1 << slot_bits) - 1)
    run = np.bincount(quotient.astype(np.int64), minlength=1 << slot_bits).astype("<u4")
    wide = run >= 255
    large = n >= 255
    head = _HEAD.pack(slot_bits, len(a), int(wide.sum()), int(large.sum()))
    rest = a & np.uint64((1 << left) - 1)
    return b"".join([
        head, np.where(wide, 255, run).astype(np.uint8).tobytes(), run[wide].tobytes(), _low_bytes(rest, left), _low_bytes(b, bits),
        np.where(large, 255, n).astype(np.uint8).tobytes(), n[large].astype("<u8").tobytes(),
    ])


def from_filter(data: bytes, block: int, bits: int, block_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a filter: both halves and the counters."""
    slot_bits, n, wide, large = _HEAD.unpack_from(data)
    at = _HEAD.size
    run = np.frombuffer(data, np.uint8, 1 << slot_bits, at).astype(np.int64)
    at += 1 << slot_bits
    run[run == 255] = np.frombuffer(data, "<u4", wide, at)
    at += 4 * wide
    left = bits - block_bits - slot_bits
    rest, at = _from_bytes(data, at, n, left)
    b, at = _from_bytes(data, at, n, bits)
    counter = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counter[counter == 255] = np.frombuffer(data, "<u8", large, at + n)
    quotient = np.repeat(np.arange(1 << slot_bits, dtype=np.uint64), run) | np.uint64(block << slot_bits)
    return quotient << np.uint64(left) | rest, b, counter


def _lang_hash(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Bytes in small letters, starts and ends of words, their hashes by language, their texts' numbers and the texts' languages, some texts at a time."""
    known: dict[str, np.uint64] = {}
    for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        for x in langs:
            if x not in known:
                known[x] = _lang_hash(x)
        for first, last, data, offsets in groups(texts):
            data = LOWER[data]
            s, e = words(data, _WORD)
            text = np.searchsorted(offsets, s, side="right") - 1
            own = np.array([known[x] for x in langs[first:last]], np.uint64)
            yield data, s, e, mix(word_hashes(data, s, e) ^ own[text]), text, langs[first:last]


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, hash, n: a row for each word of a task, or of some of its texts."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("hash", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flushed() -> pa.RecordBatch:
            rows = list(held.items())
            held.clear()
            columns = [pa.array([r[0] for _, r in rows], pa.string()), pa.array([r[1].decode() for _, r in rows], pa.string())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.array([h for h, _ in rows], np.uint64).view(np.int64)), pa.array([r[2] for _, r in rows], pa.int64())], schema=schema)

        for data, s, e, h, text, langs in _read(batches):
            own, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            size = e - s
            if not np.array_equal(size, size[first][back]) or not np.array_equal(data[ranges(s, size)], data[ranges(s[first][back], size)]):
                raise ArithmeticError("two words have the same hash")
            for k, i, c in zip(own.tolist(), first.tolist(), n.tolist(), strict=True):
                lang, word = langs[text[i]], data[s[i] : e[i]].tobytes()
                if (row := held.get(k)) is None:
                    held[k] = [lang, word, c]
                elif row[0] == lang and row[1] == word:
                    row[2] += c
                else:
                    raise ArithmeticError("two words have the same hash")
            if len(held) >= HELD_WORDS:
                yield flushed()
        if held:
            yield flushed()

    return docs.mapInArrow(run, "lang string, word string, hash long, n long")


def _bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """64-bit words of a bitmap of a written table's keys, 32 bits a key up to MOST_BITS."""
    bits = min(max(1 << (32 * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    found = keys.select(F.shiftright(slot, 6).cast("int").alias("at"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit")).distinct()
    rows = found.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _may(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + _ROUND[0]) + b)


class Ids:
    """Ids of words by hash; the few that would share one are listed with their own."""

    def __init__(self, hashes: list[int]):
        self.hashes = np.sort(np.array(hashes, np.int64).view(np.uint64))

    def of(self, h: np.ndarray) -> np.ndarray:
        out = h >> np.uint64(64 - ID_BITS)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, np.uint64(RESERVED) + at.astype(np.uint64), out)
        return out


def _shared_ids(all_words: DataFrame, least: int) -> list[int]:
    """Hashes of words with the id of another one of which either is frequent, or with an id of the reserved range. Few: with 10**9 words some 10**4."""
    own = all_words.select("hash", "n", F.expr(f"shiftrightunsigned(hash, {64 - ID_BITS})").alias("id"))
    several = own.groupBy("id").agg(F.count("*").alias("c"), F.max("n").alias("most")).where(f"c > 1 AND most >= {least} OR id >= {RESERVED}").select("id")
    found = [r.hash for r in own.join(several, "id").select("hash").limit((1 << 20) + 1).collect()]
    if len(found) > 1 << 20:
        raise ValueError("too many words share an id; use more ID_BITS")
    return found


def _filters(docs: DataFrame, size: int, block_bits: int, word_map, ids: Ids, pair_map=None) -> DataFrame:
    """block, filter: the phrases of so many words of each task."""
    schema = pa.schema([("block", pa.int32()), ("filter", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        bits = 0

        def flushed() -> pa.RecordBatch:
            a, b, n = counted(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            held.clear()
            block = (a >> np.uint64(bits - block_bits)).astype(np.int64)
            start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            spans = zip(start.tolist(), np.append(start[1:], len(a)).tolist(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(block[start], pa.int32()), pa.array([to_filter(a[i:j], b[i:j], n[i:j], bits, block_bits) for i, j in spans], pa.binary())], schema=schema)

        for data, s, e, h, _, _ in _read(batches):
            if len(s) < size:
                continue
            marks = np.cumsum(_MARK[data])  # a text ends with one
            known = _may(word_map.value, h)
            own = ids.of(h)
            good = (marks[s[1:]] == marks[e[:-1] - 1]) & known[1:] & known[:-1]
            if size == 3:
                good &= _may(pair_map.value, pair_key(own[:-1], own[1:]))
                good = good[1:] & good[:-1]
            at = np.flatnonzero(good)
            if not len(at):
                continue
            a, b, bits = pack([own[at + k] for k in range(size)])
            held.append(permute(a, b, bits))
            if sum(len(x) for x, _ in held) >= HELD:
                yield flushed()
        if held:
            yield flushed()

    return docs.mapInArrow(run, "block int, filter binary")


def _merged(filters: DataFrame, size: int, block_bits: int, least: int) -> DataFrame:
    """id1, id2 (, id3), n of what all filters together hold at least so often; pairs with the key of their bitmap."""
    names = [f"id{k + 1}" for k in range(size)]
    columns = [*names, "n", *(["key"] if size == 2 else [])]
    schema = pa.schema([(c, pa.int64()) for c in columns])

    def entries(block: int, parts: list[bytes]) -> pa.RecordBatch:
        bits = ID_BITS if size == 2 else ID_BITS * 3 // 2
        a, b, n = (np.concatenate(x) for x in zip(*(from_filter(p, block, bits, block_bits) for p in parts), strict=True))
        a, b, n = counted(a, b, n)
        often = n >= least
        ids = unpack(*restore(a[often], b[often], bits), size)
        more = [pair_key(*ids).view(np.int64)] if size == 2 else []
        return pa.RecordBatch.from_arrays([pa.array(x) for x in [*(i.view(np.int64) for i in ids), n[often], *more]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = -1, []
        for batch in batches:  # sorted by block
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != block and parts:
                    yield entries(block, parts)
                    parts = []
                block = k
                parts.append(data)
        if parts:
            yield entries(block, parts)

    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def _score(a: str, left: str, right: str) -> Column:
    wide = "cast({} as decimal(19, 0))".format
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, per_block: int = PER_BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of docs (text, lang)."""
    keep = Scratch(spark)
    docs = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    all_words = keep.save(_word_counts(docs).groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")), "words")
    if not all_words.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        raise ArithmeticError("two words have the same hash")
    totals = all_words.groupBy("lang").agg(F.sum("n").alias("n"))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    block_bits = max(LEAST_BLOCK_BITS, (n_words // per_block).bit_length())

    shared = _shared_ids(all_words, least)
    ids, context = Ids(shared), spark.sparkContext
    own = spark.createDataFrame([(int(h), RESERVED + k) for k, h in enumerate(ids.hashes.view(np.int64))], "hash long, own long")
    frequent = all_words.where(F.col("n") >= least).join(F.broadcast(own), "hash", "left")
    frequent = keep.save(frequent.select("lang", "word", "hash", "n", F.coalesce("own", F.expr(f"shiftrightunsigned(hash, {64 - ID_BITS})")).alias("id")), "frequent")
    word_map = context.broadcast(_bitmap(frequent, "hash"))
    found = keep.save(_merged(_filters(docs, 2, block_bits, word_map, ids), 2, block_bits, least), "pairs")
    pair_map = context.broadcast(_bitmap(found, "key"))
    triples = keep.save(_merged(_filters(docs, 3, block_bits, word_map, ids, pair_map), 3, block_bits, least), "triples")

    def named(k: int) -> DataFrame:
        return frequent.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}"), *(["lang"] if k == 1 else []))

    pairs = keep.save(found.select("id1", "id2", "n").join(named(1), "id1").join(named(2), "id2"), "named")
    head = pairs.select("id1", "id2", "lang", "w1", "w2", "n1", F.col("n").alias("n12"))
    tail = pairs.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("w2").alias("w3"), F.col("n2").alias("n3"), F.col("n").alias("n23"))
    triples = keep.save(triples.join(head, ["id1", "id2"]).join(tail, ["id2", "id3"]), "long")

    inside = triples.select("id1", "id2", "n").union(triples.select("id2", "id3", "n")).groupBy("id1", "id2").agg(F.max("n").alias("longer"))
    free = pairs.join(inside, ["id1", "id2"], "left").where(f"longer IS NULL OR 100 * longer < {covered} * n")
    two = free.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"), _score("n", "n1", "n2").alias("score"))
    cuts = triples.withColumn("s1", _score("n", "n1", "n23")).withColumn("s2", _score("n", "n12", "n3"))
    first = F.col("s1") <= F.col("s2")
    three = cuts.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"),
        F.when(first, F.col("n1")).otherwise(F.col("n12")).alias("l"), F.when(first, F.col("n23")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    ranked = keep.save(two.unionByName(three), "scored")
    ranked = ranked.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")  # a row a language


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, read(spark, sf_dir, "documents"))


ORACLE = rf"""WITH p AS (SELECT row_number() OVER () AS p, lang, piece FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT p, lang, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM (SELECT p, lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS ws FROM p)),
g AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY p ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang), f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}), f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
inside AS (SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, w1 AS x, w2 AS y, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
two AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, a.f AS l, b.f AS r FROM f2 JOIN f1 a ON a.lang = f2.lang AND a.w1 = f2.w1 JOIN f1 b ON b.lang = f2.lang AND b.w1 = f2.w2
  LEFT JOIN inside ON inside.lang = f2.lang AND x = f2.w1 AND y = f2.w2 WHERE longer IS NULL OR 100 * longer < {COVERED} * f2.f),
three AS (SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, unnest([a.f, ab.f]) AS l, unnest([bc.f, c.f]) AS r, unnest([1, 2]) AS k FROM f3 t JOIN f1 a ON a.lang = t.lang AND a.w1 = t.w1 JOIN f1 c ON c.lang = t.lang AND c.w1 = t.w3
  JOIN f2 ab ON ab.lang = t.lang AND ab.w1 = t.w1 AND ab.w2 = t.w2 JOIN f2 bc ON bc.lang = t.lang AND bc.w1 = t.w2 AND bc.w2 = t.w3),
s AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM (SELECT *, 1 AS k FROM two UNION ALL SELECT * FROM three)),
cut AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM cut)
SELECT lang, rank, phrase, a, l, r, n.n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}"""
