"""BPE encoding and decoding with content-defined chunk reuse.

A gear hash over the last 16 bytes cuts every text into chunks whose borders depend on
content only, so a passage that many documents share is cut alike in all of them. Each
worker encodes a chunk once and keeps its ids in a bounded table.

A chunk border may fall inside a word, so the ids next to it are not those of the whole
text. A chunk's *middle* reaches from its first to its last agreed position, a printable
ASCII character followed by a space or newline: the byte-level pre-tokenizer has a border
there whatever surrounds it (files with another one are refused). Agreed positions also cut
a middle into pieces, and a piece that an earlier chunk had is not encoded again. What lies
between two middles is the join. Joins are repaired by encoding them again together with the
last piece before and the first piece after; the ids of these two must come out exactly as in
the chunks, else the join takes in a further piece on either side, until they agree.

Ids are decoded through the vocabulary's bytes, and the decoded bytes of every text are
compared with the text, so that a clash of span hashes can't pass: such a text is encoded whole.

Cases: null text counts as empty (no tokens); ids of repeated rows are repeated; rows keep
their order within a partition; other columns are ignored, also when they are named like
the outputs. Memory per worker is one Arrow batch, about 1 MB of texts (or one longer text) at
work, and the tables (``HELD_IDS`` each, or the ids of that text, twice). A global table of chunks would shuffle every text
and all ids, more than 1.5 times the input, so reuse is per worker and a lost executor loses
nothing but its tables.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .hashing import groups, mix, ranges, word_hashes

#: Ids (and spans) that a generation of a table may hold; two generations are kept.
HELD_IDS = 1 << 21
AVERAGE_CHUNK, LEAST_CHUNK = 512, 64

_GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint32)
_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[0x21:0x7F] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True


def chunk_borders(data: np.ndarray, average: int = AVERAGE_CHUNK) -> np.ndarray:
    """Positions where a chunk may start: the gear hash of the 16 bytes before has its top bits clear."""
    g = _GEAR[data]
    for k in (1, 2, 4, 8):  # doubles the window each time
        g[k:] += g[:-k] << np.uint32(k)
    hit = np.flatnonzero(g < np.uint32((1 << 32) // average)) + 1
    hit = hit[(hit >= 16) & (hit < len(data))]
    return hit[(data[hit] & 0xC0) != 0x80]  # never inside a character


def spaced(borders: np.ndarray, least: int = LEAST_CHUNK) -> list[int]:
    """Of the borders those at least so far from the one before."""
    if len(borders) and (len(borders) == 1 or np.diff(borders).min() >= least) and borders[0] >= least:
        return borders.tolist()
    out, last = [], 0
    for b in borders.tolist():
        if b - last >= least:
            out.append(b)
            last = b
    return out


def agreed(data: np.ndarray) -> np.ndarray:
    """Positions before which every text of the group may be cut."""
    return np.flatnonzero(_PRINTABLE[data[:-1]] & _GAP[data[1:]]) + 1


class Table:
    """Ids of spans by the spans' hash. When the young generation is full it becomes the old one, and what is asked for again moves back."""

    def __init__(self, most: int = HELD_IDS):
        self.most, self.young, self.old = most, self._none(), self._none()

    @staticmethod
    def _none() -> tuple[np.ndarray, ...]:
        """Sorted keys, starts and lengths; ids."""
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @staticmethod
    def _find(part: tuple[np.ndarray, ...], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are held, with lengths and ids of those."""
        held, starts, lengths, ids = part
        if not len(held):
            return np.zeros(len(keys), bool), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        there = held[at] == keys
        at = at[there]
        return there, lengths[at], ids[ranges(starts[at], lengths[at])]

    def _add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        held, starts, own, arena = self.young
        if len(held) and max(len(held), len(arena)) + max(len(keys), len(ids)) > self.most:
            self.old, (held, starts, own, arena) = self.young, self._none()
        starts, own = np.append(starts, len(arena) + np.cumsum(lengths) - lengths), np.append(own, lengths)
        held, order = (k := np.append(held, keys)), np.argsort(k, kind="stable")
        self.young = held[order], starts[order], own[order], np.append(arena, ids)

    def of(self, keys: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
        """(length of each key's ids, all ids in order, number of keys made); make(places of new keys) gives lengths and ids."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), 0
        own, first, back = np.unique(keys, return_index=True, return_inverse=True)
        young, young_n, young_ids = self._find(self.young, own)
        rest = np.flatnonzero(~young)
        old, old_n, old_ids = self._find(self.old, own[rest])
        new = rest[~old]
        if len(new):
            new_n, new_ids = make(first[new])
        else:
            new_n, new_ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        where = np.concatenate([np.flatnonzero(young), rest[old], new])
        n, ids = np.concatenate([young_n, old_n, new_n]), np.concatenate([young_ids, old_ids, new_ids])
        if len(rest):
            self._add(own[where[len(young_n) :]], n[len(young_n) :], ids[len(young_ids) :])
        lengths, starts = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
        lengths[where], starts[where] = n, np.cumsum(n) - n
        return lengths[back], ids[ranges(starts[back], lengths[back])], len(new)


class ChunkCodec:
    """Encodes and decodes texts chunk by chunk; one instance per Python worker."""

    def __init__(self, path: str, held: int = HELD_IDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self._refuse_others(json.loads(self.tok.to_str()))
        table = self._bytes_of_ids()
        self.width = np.array([len(b) for b in table], np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.chunks, self.pieces, self.joins = Table(held), Table(held), Table(held)
        self.made = {"chunks": 0, "pieces": 0, "joins": 0, "whole": 0, "widened": 0}  # what was encoded, for tests

    @staticmethod
    def _refuse_others(said: dict) -> None:
        """Agreed positions hold for the byte-level pre-tokenizer with its own pattern, and added tokens that keep to themselves."""
        before, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        fits = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        fits = fits and model.get("type") == "BPE" and not model.get("dropout") and said.get("normalizer") is None
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in said.get("added_tokens") or [])
        if not fits or not plain:
            raise ValueError("the tokenizer is no plain byte-level BPE, so chunks of its texts can't be joined")

    def _bytes_of_ids(self) -> list[bytes]:
        # the byte-level alphabet: printable characters stand for themselves, the rest for 256 + n
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        alphabet = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        table = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            table[i] = added[i].encode() if i in added else bytes(alphabet[c] for c in piece)
        return table

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _encode_pieces(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of pieces. Each starts with a gap and ends with a printable character, so they can stand in one text."""
        lengths, out = [], []
        for at in range(0, len(s), 4096):
            a, b = s[at : at + 4096], e[at : at + 4096]
            ids = self._ids([data[ranges(a, b - a)].tobytes()])[0]
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(b - a)) + 1
            lengths.append(np.diff(ends, prepend=0))
            out.append(ids)
        self.made["pieces"] += len(s)
        return np.concatenate(lengths), np.concatenate(out)

    def _encode_chunks(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of chunk middles, by way of their pieces."""
        self.made["chunks"] += len(s)
        lo, hi = np.searchsorted(cuts, s), np.searchsorted(cuts, e)
        at = ranges(lo, hi - lo)
        begin, end = cuts[at], cuts[at + 1]
        n, ids, _ = self.pieces.of(word_hashes(data, begin, end), lambda new: self._encode_pieces(data, begin[new], end[new]))
        sums = np.append(0, np.cumsum(n))
        per = np.cumsum(hi - lo)
        return sums[per] - sums[per - (hi - lo)], ids

    def _encode_joins(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, cuts: np.ndarray, begins: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of joins s..e in texts begins..closes. One that agrees nowhere in its text gets no ids, so the text is encoded whole."""
        self.made["joins"] += len(s)
        lo, hi = np.searchsorted(cuts, s), np.searchsorted(cuts, e)
        left, right = s > begins, e < closes
        out = [np.zeros(0, np.uint32)] * len(s)
        open_, reach = np.arange(len(s)), 1
        while len(open_):
            # a window reaches so many pieces beyond the join as it must agree with
            begin = np.where(left[open_], cuts[np.maximum(lo[open_] - reach, 0)], s[open_])
            end = np.where(right[open_], cuts[np.minimum(hi[open_] + reach, len(cuts) - 1)], e[open_])
            inside = (begin >= begins[open_]) & (end <= closes[open_]) & ((reach == 1) | (lo[open_] >= reach) | (hi[open_] + reach < len(cuts)))
            open_, begin, end = open_[inside], begin[inside], end[inside]
            windows = self._ids([data[a:b].tobytes() for a, b in zip(begin, end, strict=True)])
            sides = self._sides(data, begin, s[open_]), self._sides(data, e[open_], end)
            again = []
            for k, ids, before, after in zip(open_.tolist(), windows, *sides, strict=True):
                stop = len(ids) - len(after)
                if stop >= len(before) and (ids[: len(before)] == before).all() and (ids[stop:] == after).all():
                    out[k] = ids[len(before) : stop]
                else:
                    again.append(k)
            self.made["widened"] += len(again)
            open_, reach = np.array(again, np.int64), reach * 2
        lengths = np.array([len(x) for x in out], np.int64)
        return lengths, np.concatenate(out)

    def _sides(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
        """Ids of the spans as the chunks have them."""
        some = np.flatnonzero(e > s)
        n, ids, _ = self.pieces.of(word_hashes(data, s[some], e[some]), lambda new: self._encode_pieces(data, s[some][new], e[some][new]))
        lengths = np.zeros(len(s), np.int64)
        lengths[some] = n
        return np.split(ids, np.cumsum(lengths)[:-1]) if len(s) else []

    def _group(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, decoded bytes) of each text of a group; a newline ends each in data."""
        begin, end = offsets[:-1], offsets[1:] - 1
        cuts = agreed(data)
        of = np.searchsorted(offsets, cuts, side="right") - 1
        cuts = cuts[(cuts > begin[of]) & (cuts < end[of])]  # inside texts only
        cuts = cuts if len(cuts) else np.full(1, -1)
        borders = [b for i, (a, z) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)) for b in ([a] if z - a <= LEAST_CHUNK else [a, *(a + x for x in spaced(chunk_borders(data[a:z])))])]
        starts = np.array(borders, np.int64)
        text = np.searchsorted(offsets, starts, side="right") - 1
        ends = np.where(np.append(text[1:] == text[:-1], False), np.append(starts[1:], 0), end[text])
        # a chunk's middle: from its first agreed position to its last
        first, last = np.searchsorted(cuts, starts, side="right"), np.searchsorted(cuts, ends) - 1
        full = last > first
        m_s, m_e, m_of = cuts[first[full]], cuts[last[full]], text[full]
        # joins: what is between middles, and between them and the text's ends
        count = np.bincount(m_of, minlength=len(begin))
        slot = np.arange(len(m_s)) + m_of + 1  # place of the join after each middle
        j_s, j_e = np.empty(len(m_s) + len(begin), np.int64), np.empty(len(m_s) + len(begin), np.int64)
        heads = np.cumsum(count + 1) - count - 1
        j_s[heads], j_s[slot] = begin, m_e
        j_e[heads + count], j_e[slot - 1] = end, m_s
        some = np.flatnonzero(j_e > j_s)
        own_begin, own_end = np.repeat(begin, count + 1)[some], np.repeat(end, count + 1)[some]

        n_m, ids_m, _ = self.chunks.of(word_hashes(data, m_s, m_e), lambda new: self._encode_chunks(data, m_s[new], m_e[new], cuts))
        lo, hi = np.searchsorted(cuts, j_s[some]), np.searchsorted(cuts, j_e[some])
        a = np.where(j_s[some] > own_begin, cuts[np.maximum(lo - 1, 0)], j_s[some])
        b = np.where(j_e[some] < own_end, cuts[np.minimum(hi + 1, len(cuts) - 1)], j_e[some])
        keys = mix(word_hashes(data, a, b) + (j_s[some] - a).astype(np.uint64) * np.uint64(1 << 32) + (b - j_e[some]).astype(np.uint64))
        n_j, ids_j, _ = self.joins.of(keys, lambda new: self._encode_joins(data, j_s[some][new], j_e[some][new], cuts, own_begin[new], own_end[new]))

        # joins and middles take turns
        n = np.zeros(len(j_s) + len(m_s), np.int64)
        at_j = np.arange(len(j_s)) + np.searchsorted(slot, np.arange(len(j_s)), side="right")
        at_m = at_j[slot] - 1
        n[at_j[some]], n[at_m] = n_j, n_m
        where = np.zeros(len(n), np.int64)
        where[at_j[some]], where[at_m] = np.cumsum(n_j) - n_j, len(ids_j) + np.cumsum(n_m) - n_m
        ids = np.append(ids_j, ids_m)[ranges(where, n)]
        decoded = self.bytes[ranges(self.place[ids], self.width[ids])]
        ends_of = np.append(0, np.cumsum(n))
        edge = ends_of[np.append(at_j[heads], len(n))]
        byte = np.append(0, np.cumsum(self.width[ids]))[edge]
        for i in range(len(begin)):
            own, back = ids[edge[i] : edge[i + 1]], decoded[byte[i] : byte[i + 1]]
            if not np.array_equal(back, data[begin[i] : end[i]]):  # a clash of hashes
                self.made["whole"] += 1
                own = self._ids([data[begin[i] : end[i]].tobytes()])[0]
                back = self.bytes[ranges(self.place[own], self.width[own])]
            yield own, back

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian uint32, decoded UTF-8) of each text."""
        for _, _, data, offsets in groups(texts):
            for ids, decoded in self._group(data, offsets):
                yield ids.astype("<u4", copy=False).tobytes(), decoded.tobytes()


_codecs: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with_ids: also ids (array of int) and decoded text.

    tokenizer: path of a byte-level BPE file in the tokenizers library's format, the same on all machines.
    """
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())]
        schema += ", ids array<int>, decoded string"
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = list(own.encode(batch.column(1).cast(pa.binary()).to_pylist()))
                columns = [
                    pa.array([len(i) // 4 for i, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for _, d in rows], pa.string()),
                ]
                if with_ids:
                    columns += [pa.array([np.frombuffer(i, "<i4") for i, _ in rows], pa.list_(pa.int32())), pa.array([d.decode() for _, d in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=pa.schema([batch.schema.field(0), *fields]))

    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text")).mapInArrow(run, f"doc_id {id_type}, {schema}")


def byte_bpe() -> str:
    """Place of the public byte-level vocabulary; STUDYLOOM_BYTE_BPE overrides it."""
    if given := os.environ.get("STUDYLOOM_BYTE_BPE"):
        return given
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), byte_bpe())
