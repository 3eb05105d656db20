"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of letters and digits, ASCII capitals as small) are hashed to embeddings; a word's is the
sum of its own and those of its first ``PREFIXES`` bytes, so that inflected and rare forms share what is learnt.
Filters of several widths run over the sequence of a whole text. Their values are max-pooled in
``STRANDS`` interleaved strands (place modulo ``STRANDS``); the highest strand and the mean of the
strands, rectified, enter a logistic unit, so one strong sign counts as well as several weak ones.
Every worker scores whole texts in bounded groups.

Training reads all labelled rows whose crc32(doc_id as text) mod 5 is not 0, with their whole texts. They are dealt over at most
``SHARDS`` shards by hash, whatever the number of partitions; in each round every shard's rows are streamed in order of hash, beginning with the common
network, and the networks of all shards are averaged, an embedding over the shards that changed it. The driver holds one network,
whose size is fixed; values are summed as whole numbers, so the order of the tasks doesn't matter.
One part in five of the rows, by another hash, calibrates: for each
language a threshold is chosen there from counts of all these rows by label and logit (in steps of 1 / ``STEPS``), and the score is shifted
so that 0.5 is the threshold.
The language is told from the text's own function words, never from a column.

Scores, rounded to six places, depend on the text only; labels, lang, source and doc_id are no inputs. Reruns agree.

Cases: null, empty or wordless text is scored like any other, as an empty sequence; labels null or
other than 0 and 1 are not learnt; rows that repeat a labelled doc_id with one text count once, contradicting labels each; without both
labels among the labelled rows every score is the share of toxic labels, 0 if there are none; repeated rows
get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import copy
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .hashing import ALNUM, LOWER, groups, mix, ranges, word_hashes, words

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
PREFIXES, STRANDS = (4, 5, 6, 7), 8
#: Rows of a shard, about, as long as there are at most SHARDS; passes over few rows and over many; a step's texts and bytes.
SHARD, SHARDS, EPOCHS, PASSES, BATCH, BATCH_BYTES, RATE = 8192, 16, 8, 3, 32, 1 << 20, 0.03
#: Steps of a logit's histogram, and the fraction of one that a trained value is rounded to.
STEPS, UNIT = 64, 1 << 30

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with this be at by from or an",
    "fr": "le la les de des et un une du en que qui dans pour sur pas par au avec est ce",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "es": "el la los las de que y en un una del se por con para su al como más no es",
}


def _hash_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    s, e = words(data, ALNUM)
    return word_hashes(LOWER[data], s, e)


class Sequences:
    """Hashed word sequences of several texts: distinct words' embedding rows, word numbers in order with padding, first strand row of each text, languages."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        s, e = words(data, ALNUM)
        low = LOWER[data]
        h, first, back = np.unique(word_hashes(low, s, e), return_index=True, return_inverse=True)
        edges, n = np.searchsorted(s, offsets), len(offsets) - 1
        of = np.repeat(np.arange(n), np.diff(edges))
        self.language = self._languages(h[back], of, n)
        self.rows = np.full((len(h) + 1, 1 + len(PREFIXES)), BUCKETS, np.int64)  # the last word is padding, and so is the last embedding
        self.rows[:-1, 0] = (mix(h) % np.uint64(BUCKETS)).astype(np.int64)
        s, e = s[first], e[first]
        for k, size in enumerate(PREFIXES):
            long = np.flatnonzero(e - s > size)
            own = word_hashes(low, s[long], s[long] + size) + np.uint64(size)
            self.rows[long, 1 + k] = (mix(own) % np.uint64(BUCKETS)).astype(np.int64)
        self._place(back, np.diff(edges))

    def _place(self, numbers: np.ndarray, length: np.ndarray) -> None:
        """Each text fills whole rows of strands, and ends with as much padding as the widest filter reaches beyond its place."""
        filled = -(-(length + max(WIDTHS) - 1) // STRANDS)
        self.start = np.cumsum(filled) - filled
        self.ids = np.full(int(filled.sum()) * STRANDS, len(self.rows) - 1, np.int32)
        self.ids[ranges(self.start * STRANDS, length)] = numbers
        self.last = np.concatenate([(self.start + filled) * STRANDS - 1 - k for k in range(max(WIDTHS) - 1)])  # whence filters reach into the next text

    @staticmethod
    def _languages(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        counts = np.stack([np.bincount(of[np.isin(h, known)], minlength=n) for known in _known()], 1)
        return np.where(counts.max(1, initial=0) > 0, counts.argmax(1), len(FUNCTION_WORDS))


_held: list[np.ndarray] = []


def _known() -> list[np.ndarray]:
    if not _held:
        _held.extend(np.sort(_hash_words(w)) for w in FUNCTION_WORDS.values())
    return _held


class Network:
    """Embeddings, filters and the logistic unit."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        self.emb = (rng.standard_normal((BUCKETS + 1, DIM)) * 0.005).astype(np.float32)
        self.emb[BUCKETS] = 0
        self.filters = [(rng.standard_normal((k, DIM, FILTERS)) * 0.3).astype(np.float32) for k in WIDTHS]
        self.bias = np.zeros(n, np.float32)
        self.out = (rng.standard_normal(2 * n) * 0.1).astype(np.float32)  # of the highest strand, of the mean
        self.shift = np.zeros(1, np.float32)
        self.sq = {"emb": np.full(BUCKETS + 1, 1e-3, np.float32), "bias": np.full_like(self.bias, 1e-3), "out": np.full_like(self.out, 1e-3), "shift": np.full(1, 1e-3, np.float32)}
        self.sq |= {f"f{w}": np.full_like(f, 1e-3) for w, f in enumerate(self.filters)}

    def _maps(self, q: Sequences, kind: type = np.float32) -> Iterator[np.ndarray]:
        """Values of each width's filters at every place."""
        e = self.emb[q.rows].sum(1, dtype=kind)[q.ids]
        for f in (f.astype(kind) for f in self.filters):
            y = e @ f[0]
            for j in range(1, len(f)):
                y[:-j] += e[j:] @ f[j]
            y[q.last] = 0
            yield y

    def _features(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rectified strands (text, strand, filter), the highest's number, and the logistic unit's inputs."""
        a = np.maximum(pooled + self.bias, 0)
        top = a.argmax(1)
        return a, top, np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1)], 1)

    def logits(self, q: Sequences) -> np.ndarray:
        # in double precision, as the rounded score must not depend on the texts around
        pooled = [np.maximum.reduceat(y.reshape(-1, STRANDS, y.shape[1]), q.start) for y in self._maps(q, np.float64)]
        return self._features(np.concatenate(pooled, 2))[2] @ self.out + self.shift[0]

    def fit(self, batches: Iterable[tuple[Sequences, np.ndarray]], weight: float) -> np.ndarray:
        """One pass of Adagrad on the logistic loss, toxic texts weighted; only a filter's highest place in a strand gets a gradient. Returns which embeddings have changed."""
        m, sq, touched = len(self.bias), self.sq, np.zeros(BUCKETS + 1, bool)

        def step(name: str, at: np.ndarray, g: np.ndarray) -> None:
            sq[name] += g * g
            at -= (RATE * g / np.sqrt(sq[name])).astype(np.float32)

        for q, y in batches:
            n = len(y)
            word = self.emb[q.rows].sum(1)
            peak, value = [], []
            ends = np.append(q.start[1:], len(q.ids) // STRANDS)
            for v in self._maps(q):
                v = v.reshape(-1, STRANDS, FILTERS)
                at = np.stack([v[a:b].argmax(0) + a for a, b in zip(q.start, ends, strict=True)])  # text, strand, filter
                value.append(np.take_along_axis(v, at.reshape(-1, STRANDS, FILTERS), 0))
                peak.append(at * STRANDS + np.arange(STRANDS)[None, :, None])
            a, top, x = self._features(np.concatenate(value, 2))
            d = (1 / (1 + np.exp(-(x @ self.out + self.shift[0]))) - y) * np.where(y > 0, weight, 1).astype(np.float32) / n
            da = np.repeat((d[:, None] * self.out[m:] / STRANDS)[:, None], STRANDS, 1)
            np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + (d[:, None] * self.out[:m])[:, None], 1)
            dz = da * (a > 0)
            at_words, grads = [], []
            for w, (f, at) in enumerate(zip(self.filters, peak, strict=True)):
                own = dz[:, :, w * FILTERS : (w + 1) * FILTERS]
                i, s, k = np.nonzero(own)
                g, here = np.zeros_like(f), own[i, s, k]
                for j in range(len(f)):
                    ids = q.ids[np.minimum(at[i, s, k] + j, len(q.ids) - 1)]
                    for c in range(FILTERS):
                        g[j, :, c] = here[k == c] @ word[ids[k == c]]
                    at_words.append(ids)
                    grads.append(here[:, None] * f[j].T[k])
                step(f"f{w}", f, g + 1e-4 * f)
            step("out", self.out, x.T @ d + 1e-4 * self.out)
            step("bias", self.bias, dz.sum((0, 1)))
            step("shift", self.shift, d.sum(keepdims=True))
            # gradients by distinct word, then by embedding row
            ids, g = np.concatenate(at_words), np.concatenate(grads)
            seen, back = np.unique(ids, return_inverse=True)
            of_word = np.stack([np.bincount(back, g[:, c], len(seen)) for c in range(DIM)], 1)
            where, back = np.unique(q.rows[seen], return_inverse=True)
            total = np.stack([np.bincount(back.ravel(), np.repeat(of_word[:, c], q.rows.shape[1]), len(where)) for c in range(DIM)], 1).astype(np.float32)
            total += 1e-5 * self.emb[where]
            sq["emb"][where] += (total * total).mean(1)
            self.emb[where] -= RATE * total / np.sqrt(sq["emb"][where])[:, None]
            self.emb[BUCKETS] = 0
            touched[where] = True
        touched[BUCKETS] = False
        return touched

    def dense(self) -> list[np.ndarray]:
        """The values that aren't embeddings, with their sums of squares."""
        own = [*self.filters, self.bias, self.out, self.shift]
        return own + [self.sq[k] for k in (*(f"f{w}" for w in range(len(self.filters))), "bias", "out", "shift")]

    def rows(self, touched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and values of a trained network's rows, DIM + 1 values each: embeddings that changed with their sums of squares, and, below 0, all other values."""
        own = np.flatnonzero(touched)
        flat = np.concatenate([x.ravel() for x in self.dense()]).astype(np.float64)
        flat = np.append(flat, np.zeros(-len(flat) % (DIM + 1))).reshape(-1, DIM + 1)
        values = np.concatenate([np.column_stack([self.emb[own], self.sq["emb"][own]]), flat])
        return np.concatenate([own, -1 - np.arange(len(flat))]), np.rint(values * UNIT).astype(np.int64)

    def take(self, numbers: np.ndarray, values: np.ndarray) -> None:
        """Put values in the rows of such numbers."""
        own = numbers >= 0
        self.emb[numbers[own]], self.sq["emb"][numbers[own]] = values[own, :DIM], values[own, DIM]
        if own.all():
            return
        flat, at = values[~own][np.argsort(-numbers[~own])].ravel(), 0
        for x in self.dense():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size


def sequences(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int, Sequences]]:
    for first, last, data, offsets in groups(texts, most):
        yield first, last, Sequences(data, offsets)


def thresholds(logits: np.ndarray, y: np.ndarray, language: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each language, and for texts of none, the logit with the fewest errors, balanced over labels, drawn to the common one where rows are few. n: rows of each logit, label and language."""

    def best(own: np.ndarray, start: float) -> float:
        z, back = np.unique(logits[own], return_inverse=True)
        toxic, clean = (np.bincount(back, n[own] * (y[own] == k), len(z)) for k in (1, 0))
        if not toxic.sum() or not clean.sum():
            return start
        # threshold before position i: toxic under it are missed, others from it on are wrong
        missed = np.append(0, np.cumsum(toxic)) / toxic.sum()
        wrong = np.append(np.cumsum(clean[::-1])[::-1], 0) / clean.sum()
        cost = 0.5 * missed + wrong
        places = np.flatnonzero(cost <= cost.min() + 1e-12)
        low, high = places[0], places[-1]
        edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        return float((edges[low] + edges[high]) / 2)

    common = best(np.ones(len(logits), bool), 0.0)
    out = []
    for k in range(len(FUNCTION_WORDS) + 1):
        own = language == k
        toxic = n[own & (y == 1)].sum()
        share = toxic / (toxic + 20)
        out.append(share * best(own, common) + (1 - share) * common)
    return np.array(out)


def _learnt(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents and the (__doc, toxic) that may be learnt from."""
    other = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    known = labels.where("toxic IN (0, 1)").where(other).select(F.col("doc_id").alias("__doc"), F.col("toxic").cast("int").alias("toxic")).distinct()
    text = F.coalesce("text", F.lit(""))
    return docs.where(other).select("doc_id", text.alias("text"), F.xxhash64(text).alias("__of_text")), known


def keys(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, __hash, __of_text) of labelled's rows."""
    own, known = _learnt(docs, labels)
    return own.drop("text").join(known, F.col("doc_id") == F.col("__doc")).select("toxic", F.abs(F.xxhash64("doc_id")).alias("__hash"), "__of_text").distinct()


def labelled(docs: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """(data, toxic, __hash, __of_text, __shard): all labelled rows that may be learnt from, by shard in order of hash, with their whole texts, packed: they are shuffled once and kept for all rounds."""
    own, known = _learnt(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in frames:
            for at in range(0, whole.num_rows, 500):
                frame = whole.slice(at, 500)
                data = [zlib.compress(t.encode(), 6) for t in frame.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(data, pa.binary()), frame.column(2)], names=["doc_id", "data", "__of_text"])

    def meet(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, marks, before = None, [], None
        for frame in frames:
            found = []
            for name, data, of_text, toxic, key, shard in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if name != doc:
                    doc, marks = name, []
                if data is None:
                    marks.append(toxic)
                elif (name, of_text) != before:  # a repeated row counts once
                    before = name, of_text
                    found += [(data, y, key, of_text, shard) for y in marks]
            columns = zip(*found, strict=True) if found else [[]] * 5
            kinds = pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["data", "toxic", "__hash", "__of_text", "__shard"])

    packed = own.mapInArrow(pack, f"doc_id {kind}, data binary, __of_text long").withColumn("toxic", F.lit(None).cast("int"))
    marked = known.select(F.col("__doc").cast(kind).alias("doc_id"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("long").alias("__of_text"), "toxic")
    # one shuffle, a partition a shard: a document's labels come before its texts; the hash is mixed again, as its remainder by 5 says who calibrates
    both = packed.unionByName(marked).withColumn("__hash", F.abs(F.xxhash64("doc_id"))).withColumn("__shard", F.pmod(F.xxhash64("__hash"), F.lit(shards)).cast("int"))
    both = both.repartitionById(shards, F.col("__shard")).sortWithinPartitions("__shard", "__hash", "doc_id", F.col("data").isNotNull(), "__of_text", "toxic")
    return both.mapInArrow(meet, "data binary, toxic int, __hash long, __of_text long, __shard int")


def _by_shard(frames: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """The streams of the shards in a partition of labelled's rows."""

    def cut() -> Iterator[tuple[int, pa.RecordBatch]]:
        for frame in frames:
            shard = frame.column("__shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            yield from ((int(shard[a]), frame.slice(a, b - a)) for a, b in itertools.pairwise(edges) if a < b)

    for _, own in itertools.groupby(cut(), key=lambda x: x[0]):
        yield (frame for _, frame in own)


def _batches(frames: Iterator[pa.RecordBatch], held: bool | None) -> Iterator[tuple[Sequences, np.ndarray]]:
    """Steps of a stream of labelled's rows, of those that calibrate or don't, or of all; rows that repeat the one before count once."""
    texts: list[bytes] = []
    toxic: list[int] = []
    size, before = 0, None
    for frame in frames:
        for packed, y, *key in zip(*(c.to_pylist() for c in frame.columns), strict=True):
            if (key, y) == before or held is not None and held != (key[0] % 5 == 0):
                continue
            before = key, y
            data = zlib.decompress(packed)
            if texts and (len(texts) == BATCH or size + len(data) > BATCH_BYTES):
                yield _step(texts, toxic)
                texts, toxic, size = [], [], 0
            texts.append(data)
            toxic.append(y)
            size += len(data)
    if texts:
        yield _step(texts, toxic)


def _step(texts: list[bytes], toxic: list[int]) -> tuple[Sequences, np.ndarray]:
    _, _, q = next(sequences(texts, 1 << 40))
    return q, np.array(toxic, np.float32)


def train(docs: DataFrame, labels: DataFrame) -> tuple[Network | None, np.ndarray, float]:
    """(network, thresholds, share of toxic) from all labelled rows that may be learnt from."""
    spark, none = docs.sparkSession, np.zeros(len(FUNCTION_WORDS) + 1)
    n = {(r.held, r.toxic): r.n for r in keys(docs, labels).groupBy((F.col("__hash") % 5 == 0).alias("held"), "toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    share = sum(k for (_, toxic), k in n.items() if toxic) / total if total else 0.0
    if not 0 < share < 1:
        return None, none, share
    split = n.get((False, 0), 0) > 0 and n.get((False, 1), 0) > 0
    clean, toxic = (n.get((False, y), 0) if split else sum(k for (_, own), k in n.items() if own == y) for y in (0, 1))
    weight = np.sqrt(clean / toxic)  # halves the imbalance
    shards = min(SHARDS, -(-(clean + toxic) // SHARD))
    rounds = max(PASSES, min(EPOCHS, EPOCHS * SHARD // (clean + toxic)))
    dealt = labelled(docs, labels, shards).persist(StorageLevel.DISK_ONLY)
    net, values = Network(), [f"v{k}" for k in range(DIM + 1)]
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(net)  # BUCKETS * DIM floats, whatever the corpus

        def work(frames: Iterator[pa.RecordBatch], model: Broadcast = model) -> Iterator[pa.RecordBatch]:
            for shard in _by_shard(frames):
                own = copy.deepcopy(model.value)
                touched = own.fit(_batches(shard, False if split else None), weight)
                if touched.any():
                    number, value = own.rows(touched)
                    yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), *map(pa.array, np.ascontiguousarray(value.T))], names=["number", *values])

        made = dealt.mapInArrow(work, "number int, " + ", ".join(f"{v} long" for v in values))
        mean = made.groupBy("number").agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values]).toArrow()  # a row an embedding at most
        if mean.num_rows:
            net.take(mean.column("number").to_numpy(), np.column_stack([mean.column(v).to_numpy() for v in values]) / (mean.column("n").to_numpy()[:, None] * float(UNIT)))
        model.unpersist()
    if not any(held for held, _ in n):
        dealt.unpersist()
        return net, none, share

    model = spark.sparkContext.broadcast(net)

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for q, y in _batches(frames, True):
            step = np.rint(np.clip(own.logits(q), -100, 100) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(y.astype(np.int32)), pa.array(q.language.astype(np.int32))], names=["step", "toxic", "language"])

    seen = dealt.mapInArrow(place, "step int, toxic int, language int").groupBy("step", "toxic", "language").agg(F.count("*").alias("n")).toArrow()
    dealt.unpersist()
    step, y, language, count = (seen.column(c).to_numpy() for c in ("step", "toxic", "language", "n"))
    return net, thresholds(step / STEPS, y, language, count), share


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    docs = docs.select("doc_id", "text")
    net, limits, share = train(docs, labels)
    model = spark.sparkContext.broadcast((net, limits, share))  # BUCKETS * DIM floats, whatever the corpus
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, part = model.value
        for whole in batches:
            texts = [t.encode() for t in whole.column(1).to_pylist()]
            out = np.full(len(texts), part)
            if own is not None:
                for first, last, q in sequences(texts):
                    z = own.logits(q) - at[q.language]
                    out[first:last] = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic"))
