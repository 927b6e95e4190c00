"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever its low bits are all ones, so chunk edges follow the content and
move with it when text is put in or taken out. Each chunk gives one character of the signature. The block size (how many low
bits) follows the text's length and is halved while the signature is short; a fingerprint is ``block:signature:signature at
twice the block``. Two fingerprints are compared where their block sizes are equal or differ by a factor of two: likeness is
1 - d / (n + m), d the edit distance with insertions and deletions of cost 1, if they share seven characters in a row, else 0.

A null text is empty; the empty text's fingerprint is ``4::``. Equal texts have equal fingerprints and likeness 1. Very long texts
are hashed whole, one at a time; an empty table gives no rows. Ids may be of any type that has an order; repeated ids are ties
that a hash of the text orders, repeated rows follow each other. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm.common import partitions, sha256, struct_of, table, text_slices

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
REACH = 7
LENGTH = 64
"""Longest signature; its last character stands for all that follows."""
LOWEST = 2
"""Least log2 of a block size."""
COMMON = 7
BUCKETS = 4
"""Ranges of ids for each shuffle partition."""
SAMPLES = 32
"""Rows (id and hash) of the sample that gives the borders, for each range: 1.3 million at 10,000 shuffle partitions."""
ROWS = 8192
"""Rows of a batch that goes out."""
SEED = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i below n, by doubling."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of many texts, hashed together."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    n = len(raw)
    value = raw.astype(np.uint64) + np.uint64(1)
    power, inverse = _powers(_BASE, n), _powers(_INVERSE, n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(value * power, out=prefix[1:])
    first = np.maximum(np.repeat(at[:-1], np.diff(at)), np.arange(n) - REACH + 1)
    rolled = _mixed((prefix[1:] - prefix[first]) * inverse[first])
    ones = ~rolled & (rolled + np.uint64(1))  # the lowest zero bit
    level = np.minimum(63, np.log2(np.maximum(ones, np.uint64(1)).astype(np.float64))).astype(np.uint8)

    def signature(a: int, b: int, bits: int, most: int) -> str:
        ends = np.flatnonzero(level[a:b] >= bits) + a + 1
        if not len(ends) or ends[-1] != b:
            ends = np.r_[ends, b]
        if len(ends) > most:
            ends = np.r_[ends[: most - 1], b]
        starts = np.r_[a, ends[:-1]]
        chunk = _mixed((prefix[ends] - prefix[starts]) * inverse[starts])
        return LETTERS[chunk >> np.uint64(58)].tobytes().decode()

    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if a == b:
            out.append(f"{1 << LOWEST}::")
            continue
        bits = LOWEST
        while (LENGTH << bits) < b - a:
            bits += 1
        one = signature(a, b, bits, LENGTH)
        while len(one) < LENGTH // 2 and bits > LOWEST:
            bits -= 1
            one = signature(a, b, bits, LENGTH)
        out.append(f"{1 << bits}:{one}:{signature(a, b, bits + 1, LENGTH // 2)}")
    return out


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def signature_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    k = min(COMMON, len(a), len(b))
    if not k or {a[i : i + k] for i in range(len(a) - k + 1)}.isdisjoint(b[i : i + k] for i in range(len(b) - k + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1; 0 where the block sizes are not compatible."""
    if one == other:
        return 1.0
    (x, a1, a2), (y, b1, b2) = one.split(":"), other.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(signature_likeness(a1, b1), signature_likeness(a2, b2))
    if x == 2 * y:
        return signature_likeness(a1, b2)
    if y == 2 * x:
        return signature_likeness(a2, b1)
    return 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (_id, _text, _copies, _guest) by ranges of (id, hash of the text), null ids last, each range closed by a guest: the
    first row of the next range (of the first range after the last). Borders come from a random sample of ``SAMPLES`` rows a
    range, which passes the driver; hot ids are split by the hash. A row's range depends on the row alone, so that tasks that
    run again, and read in another order, deal the same. Equal rows of an Arrow batch are one row with a count of copies, so a
    hot group of them brings one row a batch."""
    spark = docs.sparkSession
    count = BUCKETS * partitions(spark)
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    order = lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1])
    sample = base.select("_id", "_hash").orderBy(F.rand(SEED)).limit(SAMPLES * count).collect()
    sample = sorted(set(map(order, sample)))
    borders = sorted({sample[i * len(sample) // count] for i in range(1, count)}) if sample else []

    def places(batch: pa.RecordBatch) -> list[int]:
        return [bisect.bisect_right(borders, order(r)) for r in zip(batch.column("_id").to_pylist(), batch.column("_hash").to_pylist())]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places(batch), pa.int32())], short.names)

    def deal_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, seen, keep, copies = batch.column("_text"), {}, [], []
            for i, key in enumerate(zip(batch.column("_id").to_pylist(), batch.column("_hash").to_pylist())):
                j = seen.setdefault(key, len(keep))
                if j < len(keep) and texts[i].equals(texts[keep[j]]):
                    copies[j] += 1
                else:
                    keep.append(i)
                    copies.append(1)
            if len(keep) < batch.num_rows:
                batch = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places(batch), pa.int32()), pa.array(copies, pa.int64())], whole.names)

    short = T.StructType([base.schema["_id"], base.schema["_hash"]]).add("_bucket", "integer")
    whole = T.StructType([*base.schema.fields]).add("_bucket", "integer").add("_copies", "long")
    firsts = base.select("_id", "_hash").mapInArrow(deal, short).groupBy("_bucket").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_hash")).alias("_f"))
    firsts = sorted((r["_bucket"], r["_f"]["_id"], r["_f"]["_hash"]) for r in firsts.collect())
    rows = [(firsts[i - 1][0], f[1], f[2]) for i, f in enumerate(firsts)]
    wanted = spark.createDataFrame(rows, T.StructType([T.StructField("_to", T.IntegerType()), T.StructField("_first", base.schema["_id"].dataType), T.StructField("_fhash", T.LongType())]))
    # One row a range, whatever number of equal rows there is.
    guests = base.join(F.broadcast(wanted), F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_hash") == F.col("_fhash")))
    guests = guests.groupBy("_to").agg(F.first("_id").alias("_id"), F.min("_text").alias("_text"))
    guests = guests.select("_id", "_text", F.lit(0).cast("long").alias("_hash"), F.col("_to").alias("_bucket"), F.lit(1).cast("long").alias("_copies"), F.lit(1).alias("_guest"))
    own = base.mapInArrow(deal_once, whole).withColumn("_guest", F.lit(0))
    return (
        own.unionByName(guests)
        .repartition(partitions(spark), "_bucket")
        .sortWithinPartitions("_bucket", "_guest", F.col("_id").asc_nulls_last(), "_hash")
        .select("_id", "_text", "_copies", "_guest")
    )


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_chars, its fingerprint, that of its edited text (see ``edited``; the next row by id, ties by a hash of the
    text, null ids last), that text's SHA-256, and likeness to the edited and to the next text. A lone row follows itself."""
    own = struct_of("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in text_slices(batches, "_text", 1 << 20):
            rows = held + list(zip(*(part.column(i).to_pylist() for i in range(4))))
            held = rows[-1:]
            marks = fingerprints([r[1].encode() for r in rows])
            # Each row goes before the next one; of equal rows all but the last go before one like themselves.
            pairs = [(i, i + 1, 1) for i in range(len(rows) - 1) if not rows[i][3]]
            pairs += [(i, i, rows[i][2] - 1) for i, _, _ in pairs if rows[i][2] > 1]
            if not pairs:
                continue
            raw = [edited(rows[i][1], rows[j][1]).encode() for i, j, _ in pairs]
            new = fingerprints(raw)
            found = pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][0] for i, _, _ in pairs], part.schema.field(0).type),
                    pa.array([len(rows[i][1]) for i, _, _ in pairs], pa.int64()),
                    pa.array(list(map(sha256, raw))),
                    pa.array([marks[i] for i, _, _ in pairs]),
                    pa.array(new),
                    pa.array([likeness(marks[i], x) for (i, _, _), x in zip(pairs, new)], pa.float64()),
                    pa.array([likeness(marks[i], marks[j]) for i, j, _ in pairs], pa.float64()),
                ],
                schema.names,
            )
            ends = np.cumsum([n for _, _, n in pairs])
            if ends[-1] == len(pairs):
                yield found
                continue
            for a in range(0, int(ends[-1]), ROWS):
                yield found.take(pa.array(np.searchsorted(ends, np.arange(a, min(a + ROWS, int(ends[-1]))), "right")))

    return in_order(docs, id_col, text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprints of every document and of its edited text."""
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))
