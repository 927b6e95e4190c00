"""Toxicity scores from subword-bag embeddings and a linear softmax trained jointly in numpy.

A text is cut into words; each word, framed by white space, gives its character n-grams of 3 to 6 characters. The n-grams of a
few neighbouring words are averaged as embedding vectors and a two-class softmax reads the average, so an unseen
misspelling scores through the n-grams it shares with known words. A text is read by its worst windows of 2, 5 and 20 words and
its 8 worst words, so that one insult in a long text counts as in a short one and faintly toxic words count together; a
logistic fit turns these readings into a score. The text's length is no reading: more words can only raise what is read.

Training sees labels of whole texts only. It starts from n-gram log-odds, takes the worst window of each toxic text as a
positive example and random and worst windows of the others as negative ones, trains, and picks the windows anew. The logistic
fit uses readings out of fold: a third of the texts is read by a model trained on the other two thirds, for texts that training
has seen are read too well. Folds and the last model are fitted side by side, each in a Spark task of its own.

Null or empty texts have no words and score 0. Null labels are ignored; a doc_id labelled
several times counts as toxic if any label says so; without both classes every text with words gets the share of toxic labels. Rows are
scored one by one: repeated rows get equal scores, very long texts are read whole, an empty table gives no rows. Columns to keep
are renamed on the way, so names like ``score`` can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dqengine.llm.common import LOWER, free_memory, materialize, struct_of, table, text_slices, utf8

SIZES = (3, 4, 5, 6)
BITS = 19
DIM = 8
WINDOW = 10
"""Words of a training example."""
WINDOWS = (2, 5, 20)
"""Words of the windows that a text is read by."""
TOP = 8
"""Worst single words that it is read by as well."""
READINGS = len(WINDOWS) + TOP
FOLDS = 3
TRAIN_ROWS = 8_000
"""Labelled rows that training may use, chosen by hash; the classifier's sample bound."""
TRAIN_BYTES = 64 << 20
"""Bytes of training texts, in the same order, after which no further text is chosen. A chosen text is read whole."""
SEED = 20240

_LOWER = np.frombuffer(LOWER, np.uint8).astype(np.uint32)
_BASE = np.uint32(0x01000193)


@dataclass
class Bag:
    """N-grams of many texts laid one after the other, each between spaces."""

    low: np.ndarray
    space: np.ndarray
    word_at: np.ndarray
    word_end: np.ndarray
    texts: int
    word_text: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, codes: np.ndarray, at: np.ndarray) -> Bag:
        """Of texts' code points, one text after the other, and where each begins."""
        n = len(at) - 1
        lengths = np.diff(at)
        low = np.full(int(at[-1]) + n + 1, 32, np.uint32)
        place = np.arange(len(codes)) + np.repeat(np.arange(1, n + 1), lengths)
        low[place] = np.where(codes < 128, _LOWER[np.minimum(codes, 127)], codes)
        space = (low == 32) | ((low >= 9) & (low <= 13))
        low[space] = 32
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        text = np.searchsorted(at[1:] + np.arange(1, n + 1), start, side="right")
        return cls(low, space, start, end, n, text)

    @classmethod
    def of_utf8(cls, raw: np.ndarray, at: np.ndarray) -> Bag:
        """Of texts' UTF-8 bytes."""
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        return cls.of(codes, np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][at])

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size: the bucket of the n-gram at each place, and whether it lies in one framed word."""
        one = self.low * np.uint32(0x9E3779B1) + np.uint32(1)
        power = [np.uint32(pow(int(_BASE), k, 1 << 32)) for k in range(8)]
        two = one[:-1] * power[1] + one[1:]
        four = two[:-2] * power[2] + two[2:] if len(two) > 2 else two[:0]
        gaps = np.cumsum(self.space, dtype=np.int32)
        for n in SIZES:
            m = len(one) - n + 1
            if m <= 0:
                continue
            if n == 3:
                h = two[:m] * power[1] + one[2 : 2 + m]
            elif n == 4:
                h = four[:m]
            elif n == 5:
                h = four[:m] * power[1] + one[4 : 4 + m]
            else:
                h = four[:m] * power[2] + two[4 : 4 + m]
            h = (h + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
            yield h >> np.uint32(32 - BITS), gaps[n - 2 : n - 2 + m] == gaps[:m]  # no space inside

    def sums(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the values of all n-grams before each word, and their number."""
        total = np.zeros(len(self.low) + 1)
        for n, (bucket, inside) in zip(SIZES, self.grams()):
            at = value[bucket]
            at[~inside] = 0
            total[2 : 2 + len(at)] += at  # belongs to the word of its second character; shifted by one for sums
        total = np.cumsum(total)
        size = self.word_end - self.word_at
        count = sum(np.maximum(0, size + 3 - n) for n in SIZES)
        return np.r_[0, np.cumsum(total[self.word_end] - total[self.word_at])], np.r_[0, np.cumsum(count)]

    def window_means(self, sums: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean value of the n-grams of the windows that start at each word, and the word after each window."""
        first = np.arange(len(self.word_at))
        last = np.minimum(first + words, np.searchsorted(self.word_text, self.word_text, side="right"))
        return (sums[last] - sums[first]) / np.maximum(1, counts[last] - counts[first]), last

    def readings(self, value: np.ndarray) -> np.ndarray:
        """(texts, ``READINGS``): the largest mean of each text for each width and for single words the ``TOP`` largest."""
        out = np.zeros((self.texts, READINGS))
        if len(self.word_at):
            heads = np.flatnonzero(np.r_[True, self.word_text[1:] != self.word_text[:-1]])
            which, sums = self.word_text[heads], self.sums(value)
            for i, words in enumerate(WINDOWS):
                out[which, i] = np.maximum.reduceat(self.window_means(*sums, words)[0], heads)
            size = np.diff(np.r_[heads, len(self.word_at)])
            single = self.window_means(*sums, 1)[0]
            order = np.lexsort((-single, self.word_text))
            rank = np.arange(len(order)) - np.repeat(heads, size)
            order, rank = order[rank < TOP], rank[rank < TOP]
            out[self.word_text[order], len(WINDOWS) + rank] = single[order]
            for i in range(1, TOP):  # texts of fewer words repeat their last one
                short = which[size <= i]
                out[short, len(WINDOWS) + i] = out[short, len(WINDOWS) + i - 1]
        return out

    def worst(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the worst training window of each text starts and ends."""
        start, end = np.zeros(self.texts, np.int64), np.zeros(self.texts, np.int64)
        if len(self.word_at):
            mean, last = self.window_means(*self.sums(value), WINDOW)
            heads = np.flatnonzero(np.r_[True, self.word_text[1:] != self.word_text[:-1]])
            which = self.word_text[heads]
            top = np.maximum.reduceat(mean, heads)
            hit = np.flatnonzero(mean == np.repeat(top, np.diff(np.r_[heads, len(mean)])))
            hit = hit[np.r_[True, self.word_text[hit[1:]] != self.word_text[hit[:-1]]]]
            start[which], end[which] = self.word_at[hit], self.word_end[last[hit] - 1]
        return start, end


@dataclass
class Model:
    """What scoring needs: the softmax's reading of each n-gram's vector, and the weights of a text's readings."""

    value: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        bag = Bag.of_utf8(raw, at)
        found = _logistic(bag.readings(self.value) @ self.weights + self.bias)
        found[np.bincount(bag.word_text, minlength=bag.texts) == 0] = 0.0
        return found


def constant(share: float) -> Model:
    """A model that scores every text alike."""
    p = min(max(share, 1e-3), 1 - 1e-3)
    return Model(np.zeros(1 << BITS, np.float32), np.zeros(READINGS), float(np.log(p / (1 - p))))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    place = np.cumsum([len(t) for t in texts]) // limit
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(texts)]
    yield from zip(cuts, cuts[1:])


def fit(texts: list[bytes], toxic: np.ndarray, rounds: int = 3, epochs: int = 4, rate: float = 0.5, folds: int = FOLDS) -> Model:
    """Trains embeddings and softmax jointly, then the logistic fit on readings out of fold; where a fold would lack a class, on
    readings of the texts trained on."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < share < 1:
        return constant(share)
    fold = np.random.default_rng(SEED + 1).permutation(len(texts)) % folds
    apart = all(0 < toxic[fold != k].mean() < 1 for k in range(folds) if (fold != k).any())
    whole, *parts = _in_tasks(texts, toxic, fold, [-1, *range(folds)] if apart else [-1], rounds, epochs, rate)
    seen = np.zeros((len(texts), READINGS))
    for k, (_, read) in enumerate(parts):
        seen[fold == k] = read
    if not apart:
        seen = _read(texts, whole[0])
    weights, bias = _calibrate(seen, toxic)
    return Model(whole[0], weights, bias)


def _read(texts: list[bytes], value: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), READINGS))
    for a, b in _chunks(texts):
        out[a:b] = Bag.of_utf8(*_joined(texts[a:b])).readings(value)
    return out


def _in_tasks(texts: list[bytes], toxic: np.ndarray, fold: np.ndarray, which: list[int], *how) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each fold the model of all other texts and its readings of the fold's (-1: the model of all texts, no readings). With a
    session each is a task that gets the sample, which ``TRAIN_BYTES`` bounds, by broadcast."""

    def one(k: int, texts, toxic, fold) -> tuple[np.ndarray, np.ndarray]:
        others = np.flatnonzero(fold != k)
        value = _values([texts[i] for i in others], toxic[others], *how)
        return value, _read([texts[i] for i in np.flatnonzero(fold == k)], value)

    spark = SparkSession.getActiveSession()
    if spark is None:
        return [one(k, texts, toxic, fold) for k in which]
    shared = spark.sparkContext.broadcast((texts, toxic, fold))
    schema = struct_of("fold integer, value binary, readings binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                value, read = one(k, *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([value.tobytes()], pa.binary()), pa.array([read.tobytes()], pa.binary())], schema.names)
        free_memory()

    rows = {r.fold: r for r in spark.range(which[0], which[-1] + 1, 1, len(which)).mapInArrow(run, schema).collect()}
    shared.unpersist()
    return [(np.frombuffer(rows[k].value, np.float32), np.frombuffer(rows[k].readings).reshape(-1, READINGS)) for k in which]


def _values(texts: list[bytes], toxic: np.ndarray, rounds: int, epochs: int, rate: float) -> np.ndarray:
    """The softmax's reading of each n-gram's vector; see the module's text for how windows are chosen."""
    rng = np.random.default_rng(SEED)
    seen = np.zeros((2, 1 << BITS), np.float32)
    mark = np.zeros(1 << BITS, np.float32)
    for text, y in zip(texts, toxic):
        bag = Bag.of_utf8(*_joined([text]))
        for bucket, inside in bag.grams():
            mark[bucket[inside]] = 1
        seen[int(y)] += mark
        mark[:] = 0
    yes, no = seen[1] / toxic.sum(), seen[0] / (1 - toxic).sum()
    value = np.log((yes + 1e-3) / (no + 1e-3)).astype(np.float32)
    vectors = (rng.normal(size=(1 << BITS, DIM)) * 0.1).astype(np.float32)
    weights = (rng.normal(size=(DIM, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    slow_v, slow_w, slow_b = np.full(1 << BITS, 1e-3, np.float32), np.full((DIM, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    for turn in range(rounds):
        examples, labels = [], []
        for a, b in _chunks(texts):
            bag = Bag.of_utf8(*_joined(texts[a:b]))
            start, end = bag.worst(value)
            for i in range(b - a):
                if end[i]:
                    examples.append(bag.low[start[i] : end[i]])
                    labels.append(toxic[a + i])
            others = np.flatnonzero(toxic[a + bag.word_text] == 0)
            for w in rng.choice(others, min(len(others), 3 * (b - a)), replace=False) if len(others) else ():
                last = min(w + WINDOW, len(bag.word_at)) - 1
                if bag.word_text[last] == bag.word_text[w]:
                    examples.append(bag.low[bag.word_at[w] : bag.word_end[last]])
                    labels.append(0)
        labels = np.array(labels, np.int64)
        bag = Bag.of(np.concatenate(examples) if examples else np.zeros(0, np.uint32), np.r_[0, np.cumsum([len(x) for x in examples])].astype(np.int64))
        bucket, head = _by_text(bag, len(examples))
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(examples)), max(1, len(examples) // 256)):
                batch = batch[head[batch + 1] > head[batch]]
                size = head[batch + 1] - head[batch]
                if not len(batch):
                    continue
                edge = np.r_[0, np.cumsum(size)[:-1]]
                ids = bucket[np.arange(size.sum()) + np.repeat(head[batch] - edge, size)]
                mean = np.add.reduceat(vectors[ids], edge, axis=0) / size[:, None]
                logit = mean @ weights + bias
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(batch)), labels[batch]] -= 1
                p /= 32
                grad_w, grad_b = mean.T @ p, p.sum(0)
                step = np.repeat((p @ weights.T) / np.sqrt(size)[:, None], size, axis=0)
                slow_w += grad_w**2
                slow_b += grad_b**2
                weights -= rate * grad_w / np.sqrt(slow_w)
                bias -= rate * grad_b / np.sqrt(slow_b)
                order = np.argsort(ids, kind="stable")
                own = ids[order]
                cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                grad, which = np.add.reduceat(step[order], cut, axis=0), own[cut]
                slow_v[which] += (grad**2).mean(1)
                vectors[which] -= rate * grad / np.sqrt(slow_v[which])[:, None]
        value = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
    return value


def _by_text(bag: Bag, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text one after the other, and where each text's begin."""
    text_of = np.zeros(len(bag.low), np.int32)
    text_of[bag.word_at] = 1
    np.cumsum(text_of, out=text_of)
    text_of = bag.word_text.astype(np.int32)[np.maximum(0, text_of - 1)] if len(bag.word_at) else text_of
    counts = [np.bincount(text_of[np.flatnonzero(inside) + 1], minlength=texts) for _, inside in bag.grams()]
    head = np.r_[0, np.cumsum(sum(counts))]
    out = np.zeros(head[-1], np.uint32)
    start = head[:-1].copy()
    for count, (bucket, inside) in zip(counts, bag.grams()):
        out[np.arange(count.sum()) + np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count)] = bucket[inside]
        start += count
    return out, head


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic fit. Readings whose weight would be negative are left out, so that no word makes a text less
    toxic."""
    used = np.arange(x.shape[1])
    while True:
        own, bias = _logistic_fit(x[:, used], y)
        if (own >= 0).all():
            break
        used = used[own >= 0]
    weights = np.zeros(x.shape[1])
    weights[used] = own
    return weights, bias


def _logistic_fit(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps over standardized readings, with a ridge."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, held = np.zeros(z.shape[1]), ridge * np.r_[np.ones(x.shape[1]), 1e-6]
    for _ in range(steps):
        p = _logistic(z @ w)
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(held), z.T @ (p - y) + held * w)
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``rows`` labelled documents (hash order) that are not held out, fewer where those before reach
    ``TRAIN_BYTES``; texts are read whole, one for each id. The ids are bounded by ``rows``, so they are broadcast to the scan of the
    texts."""
    ids = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg((F.max(label_col) > 0).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id", F.lit(SEED)), "_id")
        .limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # One text for each id: of repeated ids the least text.
    picked = texts.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    picked = materialize(picked.withColumn("_size", F.octet_length("_text")), "toxicity-sample")
    order = Window.orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = picked.select("_id", F.coalesce(F.sum("_size").over(order), F.lit(0)).alias("_before")).where(F.col("_before") < TRAIN_BYTES)  # of at most ``rows`` sizes
    got = picked.join(F.broadcast(chosen), "_id").select("_id", "_text", "_y").toArrow().sort_by("_id")
    return fit(got["_text"].cast(pa.binary()).to_pylist(), np.array(got["_y"].to_pylist(), np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """The columns ``keep`` (the id, if None) of every row with ``score`` and ``predicted``."""
    keep = keep or [id_col]
    text = "_scored_text"
    kept_as = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept_as)], F.col(text_col).alias(text))
    schema = T.StructType([docs.schema[c] for c in keep]).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    shared = docs.sparkSession.sparkContext.broadcast((model.value, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model(*shared.value)
        for part in text_slices(batches, text, 1 << 18):
            found = ready.scores(*utf8(part.column(text)))
            kept = [part.column(c) for c in kept_as]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found), pa.array((found >= threshold).astype(np.int32))], schema.names)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: a score for every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
