"""Alignment of two tokenizers' tokens by merge-path partitioning of their byte ends.

A is a byte-level BPE over a space and the text, B a sentencepiece model, which adds that space.
Tokens' byte ends are two sorted lists. ``merge_path`` cuts their merge at diagonals: a binary
search on each finds how many ends of A and of B lie before it, so the pieces hold the same number
of ends and are merged apart from each other. A piece emits which tokens overlap and where ends
of both meet. An end that a cut splits, with A's on one side and B's on the other, is told by
looking one end back, and groups that pieces cut are stitched from the meeting places in order.

Tokens are made per segment, from a space after a printable ASCII character to the next one: A's
pre-tokenizer has a border there and B has no piece across it, so a segment's ids are those
of the whole text, and one seen before isn't encoded again (bounded tables by hash). The bytes of
both sides are compared with every text, so that a clash of hashes can't pass.

An id pair's count is the number of rows that hold it linked. Texts are dealt with in shards: a
shard's distinct pairs get short numbers, and its rows keep those numbers and how often they occur.
Only a shard's distinct pairs go into the count over the corpus and come back with it; texts and
tokens aren't shuffled. The highest counts are one row for each id of A, a bound that the
vocabulary proves.

Cases: null and empty text, and text whose bytes A or B doesn't give back (B turns U+2581 into a
space), has no tokens: zeros and an empty digest. Rows that repeat a doc_id, or have none, are
documents of their own; an empty table gives no rows; other columns are ignored. A worker holds the texts of
an Arrow batch, a megabyte of texts (or one longer text) at work and a shard of at most ``SHARD``
entries besides one text's.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ChunkCodec, Table, byte_bpe
from .common import Scratch, read
from .hashing import groups, ranges, word_hashes

#: Ends of both sides that a piece merges; entries (text, pair) that a shard holds.
PIECE, SHARD = 1 << 16, 1 << 22
#: Groups of more links are counted by distinct ids.
_WIDE = 4096

_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[0x21:0x7F] = True


def merge_path(ea: np.ndarray, eb: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of A and of B lie before each diagonal of the merge, A's first where both are equal."""
    total = len(ea) + len(eb)
    diagonal = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, diagonal - len(eb)), np.minimum(diagonal, len(ea))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(diagonal), bool)
        first[open_] = ea[middle[open_]] <= eb[(diagonal - 1 - middle)[open_]]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low, diagonal - low


class Piece(NamedTuple):
    """Tokens that overlap (a, b), by place; and where an end of both is: the places of both tokens."""

    overlap_a: np.ndarray
    overlap_b: np.ndarray
    meet_a: np.ndarray
    meet_b: np.ndarray


def merged(ea: np.ndarray, eb: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> Piece:
    """The piece of ends a0..a1 and b0..b1. It needs no other piece's result, only the last end before it."""
    under_a = b0 + np.searchsorted(eb[b0:b1], ea[a0:a1], side="left")
    under_b = a0 + np.searchsorted(ea[a0:a1], eb[b0:b1], side="right")
    j = np.arange(b0, b1)
    meet = (under_b > 0) & (ea[under_b - 1] == eb[b0:b1])
    over_a, over_b = np.append(np.arange(a0, a1), under_b[~meet]), np.append(under_a, j[~meet])
    order = np.argsort(over_a + over_b, kind="stable")
    return Piece(over_a[order], over_b[order], under_b[meet] - 1, j[meet])


def meetings(ea: np.ndarray, eb: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the tokens that end groups, on both sides, and the number of overlaps: the pieces' groups stitched."""
    if not len(ea) or not len(eb):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    i, j = merge_path(ea, eb, piece)
    pieces = [merged(ea, eb, *x) for x in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist(), strict=True)]
    return np.concatenate([p.meet_a for p in pieces]), np.concatenate([p.meet_b for p in pieces]), sum(len(p.overlap_a) for p in pieces)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0..n-1 as rows, zero bytes before them, and their numbers."""
    most = len(str(max(n - 1, 0)))
    place = np.arange(n)[:, None] // 10 ** np.arange(most - 1, -1, -1)
    shown = (place > 0) | (np.arange(most) == most - 1)
    return np.where(shown, place % 10 + ord("0"), 0).astype(np.uint8), shown.sum(axis=1)


class Aligned(NamedTuple):
    """Of some texts: numbers by text; distinct pairs (a << 32 | b) and how often they are linked, one text after the other."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    pairs: np.ndarray
    often: np.ndarray
    held: np.ndarray


class Aligner:
    """Tokens of both sides and their groups; one instance a Python worker."""

    def __init__(self, byte_path: str, piece_path: str, piece: int = PIECE):
        import sentencepiece

        self.codec = ChunkCodec(byte_path)  # it refuses tokenizers without borders at spaces
        self.codec.tok.encode_special_tokens = True
        self.model, self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path), piece
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("the model has pieces across a space, so segments of its texts can't be joined")
        spelt = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.width_b = np.array([len(x) for x in spelt], np.int64)
        self.place_b, self.bytes_b = np.cumsum(self.width_b) - self.width_b, np.frombuffer(b"".join(spelt), np.uint8)
        self.digits_a, self.digits_b = _digits(len(self.codec.width)), _digits(len(spelt))
        self.held_a, self.held_b = Table(), Table()

    def _encode_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.codec.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.model.encode([t[1:] for t in texts], num_threads=1)]

    def _side(self, which: str, data: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text, and which texts' bytes they give back."""
        held, encode = (self.held_a, self._encode_a) if which == "a" else (self.held_b, self._encode_b)
        width, place, spelt = (self.codec.width, self.codec.place, self.codec.bytes) if which == "a" else (self.width_b, self.place_b, self.bytes_b)

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids = encode([data[a:z].tobytes().decode() for a, z in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            return np.array([len(x) for x in ids], np.int64), np.concatenate(ids)

        n, ids, _ = held.of(word_hashes(data, starts, ends), make)
        per = np.bincount(text, n, len(begin)).astype(np.int64)
        own = np.split(ids, np.cumsum(per)[:-1])
        got = spelt[ranges(place[ids], width[ids])]
        want = data[ranges(begin, end - begin)]
        fits = np.ones(len(begin), bool)
        if not np.array_equal(got, want):
            for i, x in enumerate(own):
                for again in (False, True):  # a clash of hashes is mended by encoding the text whole
                    own[i] = x = encode([data[begin[i] : end[i]].tobytes().decode()])[0] if again else x
                    fits[i] = np.array_equal(spelt[ranges(place[x], width[x])], data[begin[i] : end[i]])
                    if fits[i]:
                        break
        return own, fits

    def align(self, texts: list[bytes]) -> Iterator[Aligned]:
        """Of texts, none of them empty, about a megabyte at a time."""
        for first, last, data, offsets in groups([b" " + t for t in texts]):
            begin, end = offsets[:-1], offsets[1:] - 1
            cuts = np.flatnonzero(_PRINTABLE[data[:-1]] & (data[1:] == 0x20)) + 1
            starts = np.union1d(begin, cuts)
            text = np.searchsorted(offsets, starts, side="right") - 1
            ends = np.where(np.append(text[1:] == text[:-1], False), np.append(starts[1:], 0), end[text])
            a, fits_a = self._side("a", data, begin, end, starts, ends, text)
            b, fits_b = self._side("b", data, begin, end, starts, ends, text)
            good = np.flatnonzero(fits_a & fits_b)
            yield self._grouped(last - first, good, [a[i] for i in good], [b[i] for i in good])

    def _grouped(self, n: int, good: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> Aligned:
        none = np.zeros(0, np.int64)
        n_a, n_b, n_groups, n_links, held = (np.zeros(n, np.int64) for _ in range(5))
        if not len(good):
            return Aligned(n_a, n_b, n_groups, n_links, [b""] * n, none, none, held)
        n_a[good], n_b[good] = [len(x) for x in a], [len(x) for x in b]
        a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        # texts follow each other; as both sides end with the text, no group reaches over
        ends = np.cumsum(self.codec.width[a]), np.cumsum(self.width_b[b])
        meet_a, meet_b, overlaps = meetings(*ends, self.piece)
        if overlaps != len(a) + len(b) - len(meet_a):
            raise AssertionError("pieces of the merge don't fit together")
        of = np.repeat(good, n_a[good])[meet_a]
        size_a, size_b = np.diff(meet_a, prepend=-1), np.diff(meet_b, prepend=-1)
        n_groups[:] = np.bincount(of, minlength=n)
        np.add.at(n_links, of, size_a * size_b)
        pairs, often, held[:] = self._pairs(n, of, a, b, meet_a - size_a + 1, meet_b - size_b + 1, size_a, size_b)
        return Aligned(n_a, n_b, n_groups, n_links, self._written(n, good, n_a, n_b, a, b, meet_a, meet_b, size_a, size_b), pairs, often, held)

    def _pairs(self, n: int, of: np.ndarray, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs by text, how often each is linked, and their number by text."""
        many = len(self.width_b)
        cells = len(self.codec.width) * many
        few = np.flatnonzero(size_a * size_b <= _WIDE)
        each = (size_a * size_b)[few]
        k, wide = ranges(np.zeros(len(few), np.int64), each), np.repeat(size_b[few], each)
        keys = [np.repeat(of[few] * cells, each) + a[np.repeat(at_a[few], each) + k // wide] * many + b[np.repeat(at_b[few], each) + k % wide]]
        times = [np.ones(len(k), np.int64)]
        for g in np.flatnonzero(size_a * size_b > _WIDE).tolist():
            ids_a, times_a = np.unique(a[at_a[g] : at_a[g] + size_a[g]], return_counts=True)
            ids_b, times_b = np.unique(b[at_b[g] : at_b[g] + size_b[g]], return_counts=True)
            keys.append((of[g] * cells + ids_a[:, None] * many + ids_b).ravel())
            times.append((times_a[:, None] * times_b).ravel())
        if len(keys) == 1:
            key, often = np.unique(keys[0], return_counts=True)
        else:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            often = np.zeros(len(key), np.int64)
            np.add.at(often, back, np.concatenate(times))
        text, pair = key // cells, key % cells
        return pair // many << 32 | pair % many, often, np.bincount(text, minlength=n)

    def _written(self, n: int, good: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, meet_a: np.ndarray, meet_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> list[bytes]:
        """The groups of each text, written out: a1,a2|b1;a3|b2,b3."""
        wide = max(self.digits_a[0].shape[1], self.digits_b[0].shape[1])
        sheet = np.zeros((len(a) + len(b), wide + 1), np.uint8)
        # before a token of A stand the B tokens of earlier groups, before one of B also its own group's A tokens
        at_a = np.arange(len(a)) + np.repeat(meet_b + 1 - size_b, size_a)
        at_b = np.arange(len(b)) + np.repeat(meet_a + 1, size_b)
        sheet[:, wide] = ord(",")
        for at, ids, (digits, _), meet, mark in ((at_a, a, self.digits_a, meet_a, "|"), (at_b, b, self.digits_b, meet_b, ";")):
            sheet[at, wide - digits.shape[1] : wide] = digits[ids]
            sheet[at[meet], wide] = ord(mark)
        length = np.zeros(len(sheet), np.int64)
        length[at_a], length[at_b] = self.digits_a[1][a] + 1, self.digits_b[1][b] + 1
        flat = sheet.ravel()
        flat = flat[flat != 0].tobytes()
        edge = np.append(0, np.cumsum(length))[np.append(0, np.cumsum((n_a + n_b)[good]))]
        out = [b""] * n
        for i, s, e in zip(good.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out[i] = flat[s : e - 1]
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(byte_path: str, piece_path: str) -> Aligner:
    if (byte_path, piece_path) not in _aligners:
        _aligners[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _aligners[byte_path, piece_path]


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes; the first byte is their width."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _widened(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _encoded(docs: DataFrame, byte_path: str, piece_path: str, with_groups: bool, shard: int) -> DataFrame:
    """A row a text, with its shard and pair numbers there (steps between them), and a row a shard with the pairs and in how many rows they are."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, number = _aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []
        pairs: list[np.ndarray] = []
        entries = 0

        def batch_of(ids: pa.Array, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            kinds = {"shard": pa.int64(), "doc_id": ids.type, **dict.fromkeys(_NUMBERS, pa.int64()), "groups": pa.string(), "groups_sha256": pa.string(), "steps": pa.binary(), "often": pa.binary(), "pairs": pa.binary(), "rows": pa.binary()}
            given = {"shard": pa.array([task + number] * n, pa.int64()), "doc_id": ids, **columns}
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, k)) for c, k in kinds.items()], names=list(kinds))

        def flushed(id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal rows, pairs, entries, number
            if not rows:
                return
            all_pairs, back, held_by = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
            yield batch_of(pa.nulls(1, id_kind), 1, {"pairs": pa.array([all_pairs.astype("<i8").tobytes()], pa.binary()), "rows": pa.array([held_by.astype("<i8").tobytes()], pa.binary())})
            at = np.append(0, np.cumsum([r[-1] for r in rows]))
            for k in range(0, len(rows), 10_000):
                some = rows[k : k + 10_000]
                steps = [_narrow(np.diff(back[at[k + i] : at[k + i + 1]], prepend=0)) for i in range(len(some))]
                columns = {c: pa.array([r[1 + i] for r in some], pa.int64()) for i, c in enumerate(_NUMBERS)}
                columns |= {"groups": pa.array([r[5] for r in some], pa.string()), "groups_sha256": pa.array([r[6] for r in some], pa.string()), "steps": pa.array(steps, pa.binary()), "often": pa.array([r[7] for r in some], pa.binary())}
                yield batch_of(pa.array([r[0] for r in some], id_kind), len(some), columns)
            rows, pairs, entries, number = [], [], 0, number + 1

        kind = None
        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
                rows += [(i, 0, 0, 0, 0, "" if with_groups else None, "", _narrow(np.zeros(0, np.int64)), 0) for i, t in zip(ids, texts, strict=True) if not t]
                ids = iter([i for i, t in zip(ids, texts, strict=True) if t])
                for x in own.align([t for t in texts if t]):
                    at_pair = np.append(0, np.cumsum(x.held))
                    for i, numbers in enumerate(zip(x.n_a.tolist(), x.n_b.tolist(), x.n_groups.tolist(), x.n_links.tolist(), strict=True)):
                        g = x.groups[i]
                        rows.append((next(ids), *numbers, g.decode() if with_groups else None, hashlib.sha256(g).hexdigest() if g else "", _narrow(x.often[at_pair[i] : at_pair[i + 1]]), int(x.held[i])))
                    pairs.append(x.pairs)
                    entries += len(x.pairs)
                    if entries >= shard:
                        yield from flushed(kind)
        if kind is not None:
            yield from flushed(kind)

    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    schema = f"shard long, doc_id {id_type}, {numbers}, groups string, groups_sha256 string, steps binary, often binary, pairs binary, rows binary"
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text")).mapInArrow(run, schema)


def _listed(shards: DataFrame) -> DataFrame:
    """shard, number, pair, rows of each shard's distinct pairs."""
    schema = pa.schema([("shard", pa.int64()), ("number", pa.int32()), ("pair", pa.int64()), ("rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, pairs, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pair, held_by = np.frombuffer(pairs, "<i8"), np.frombuffer(rows, "<i8")
                for k in range(0, len(pair), 1 << 16):
                    n = len(pair[k : k + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(k, k + n, dtype=np.int32)), pa.array(pair[k : k + n]), pa.array(held_by[k : k + n])], schema=schema)

    return shards.where("pairs IS NOT NULL").select("shard", "pairs", "rows").mapInArrow(run, "shard long, number int, pair long, rows long")


def align(spark: SparkSession, docs: DataFrame, byte_path: str, piece_path: str, with_groups: bool = False, shard: int = SHARD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text); with_groups: also groups.

    byte_path: a byte-level BPE in the tokenizers library's format; piece_path: a sentencepiece model; the same on all machines.
    """
    keep = Scratch(spark)
    encoded = keep.save(_encoded(docs, byte_path, piece_path, with_groups, shard), "encoded")
    listed = _listed(encoded)
    counts = keep.save(listed.groupBy("pair").agg(F.sum("rows").alias("c")), "counts").withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("c").alias("most"))  # at most a row for each id of A
    ranked = counts.join(F.broadcast(highest), "a").select("pair", "c", (F.col("c") == F.col("most")).alias("best"))
    ranked = keep.save(ranked, "ranked")  # a plain table, so that the join can split what is large
    known = listed.join(ranked, "pair").select("shard", "number", "c", "best")

    names = ["doc_id", *_NUMBERS, "groups", "groups_sha256"]

    def summed(rows: pa.Table, own: pa.Table) -> pa.Table:
        count, best = np.zeros(own.num_rows, np.int64), np.zeros(own.num_rows, bool)
        at = own.column("number").to_numpy()
        count[at], best[at] = own.column("c").to_numpy(), own.column("best").to_numpy()
        n_best, total = [], []
        for steps, often in zip(rows.column("steps").to_pylist(), rows.column("often").to_pylist(), strict=True):
            number, times = np.cumsum(_widened(steps)), _widened(often)
            n_best.append(int(times @ best[number]))
            total.append(int(times @ count[number]))
        return pa.table({**{c: rows.column(c) for c in names}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", groups string, groups_sha256 string, n_best long, count_sum long"
    texts = encoded.where("pairs IS NULL").select("shard", *names, "steps", "often")
    out = texts.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(summed, schema)
    return out.select("doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))


def piece_bpe() -> str:
    """Place of the public sentencepiece model; STUDYLOOM_PIECE_BPE overrides it."""
    if given := os.environ.get("STUDYLOOM_PIECE_BPE"):
        return given
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark, read(spark, sf_dir, "documents"), byte_bpe(), piece_bpe())
