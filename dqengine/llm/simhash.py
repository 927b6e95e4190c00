"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has 64 bits: each is set where it is set in over half of the XXH64 values of its shingles. Two fingerprints
that differ in at most two bits differ in at most one bit in one of their two halves. Every distinct fingerprint is therefore
posted under the 64 variants of its halves that leave out one bit; an equality join on variants brings all linked pairs
together, and counting the differing bits verifies them.

Equal fingerprints are one class, so copies are never expanded. Variants of one class go nowhere, variants of two are a pair that the
aggregation itself returns. Only variants of more classes are dealt out, cut once more: of the other half's three pieces one must
be equal, so a slot's classes share all but 23 bits and no slot can hold more than 2^23 classes, however the documents are
spread. Slots return a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqengine.llm.common import FEW_KEYS, LOWER, freed, join_hot, materialize, partitions, struct_of, table, text_slices
from dqengine.llm.minhash import components

SHINGLE = 3
SEED = 42
BITS = 2
"""Most bits in which linked fingerprints differ; the two halves and the three pieces rest on it."""
PIECES = ((0, 11), (11, 11), (22, 10))
"""First bit and width of the pieces of a half, one more than ``BITS``."""
COMPARED = 2048
"""Classes of a slot up to which all are compared; in larger ones every possible neighbour of a class is looked up."""
SLOT_ROWS = 1_000_000
"""Rows of slots that one task takes, besides those of a single slot."""


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number; A-Z count as a-z, words end at ASCII white space, repeated shingles count as often
    as they stand. Fewer words than a shingle has are one shingle, no words give 0."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    n = max(1, len(words) - shingle + 1)
    begin, end = begin[:n], end[min(shingle, len(words)) - 1 :]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        spans = zip(begin[k : k + (1 << 15)].tolist(), end[k : k + (1 << 15)].tolist())
        hashes = np.array([digest(joined[i:j], seed) for i, j in spans], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """_id, _k0, _k1 ... (columns to keep) and _fp, the fingerprint as a signed long. A null text has no words."""
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep or [])]
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), *kept, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    schema = rows.drop("_text").schema.add("_fp", "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_text"):
            texts = part.column("_text").cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in schema.names[:-1]), pa.array(found)], schema.names)

    return rows.mapInArrow(run, schema)


def variants(classes: DataFrame) -> DataFrame:
    """(_variant, _fp): half, bit left out and the half without it, packed into one number."""
    each = classes.select("_fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_v"))
    half = "(shiftrightunsigned(_fp, 32 * (_v div 32)) & 4294967295L)"
    return each.select(F.expr(f"shiftleft(cast(_v as bigint), 32) | ({half} & ~shiftleft(1L, cast(_v % 32 as int)))").alias("_variant"), "_fp")


def slots(posted: DataFrame) -> DataFrame:
    """(_slot, _fp): each posting under its variant and each piece of the half that the variant is not of."""
    other = "(shiftrightunsigned(_fp, 32 * (1 - shiftright(_variant, 37))) & 4294967295L)"
    pieces = [F.expr(f"shiftleft(_variant, 13) | {j << 11}L | (shiftright({other}, {at}) & {(1 << width) - 1}L)") for j, (at, width) in enumerate(PIECES)]
    return posted.select(F.explode(F.array(*pieces)).alias("_slot"), "_fp")


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each reaches over edges (a, b)."""
    label = np.arange(n)
    while True:
        one, two = label[a], label[b]
        open_ = one != two
        if not open_.any():
            return label
        a, b, one, two = a[open_], b[open_], one[open_], two[open_]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label != label[label]).any():
            label = label[label]


LINKS = struct_of("a long, b long")


def linked(rows: pa.Table, bits: int = BITS, compared: int = COMPARED) -> pa.Table:
    """(a, b): each class of a slot that is linked and the least class of its slot that links lead to."""
    slot, fp = rows["_slot"].to_numpy(), rows["_fp"].to_numpy()
    order = np.lexsort((fp, slot))
    slot, fp = slot[order], fp[order]
    begin = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(slot)])
    left = np.repeat(begin + size, size) - np.arange(len(slot))  # classes from here to the end of the slot
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    active, k = np.flatnonzero(np.repeat(size <= compared, size) & (left > 1)), 1
    while len(active):
        near = active[np.bitwise_count((fp[active] ^ fp[active + k]).view(np.uint64)) <= bits]
        one.append(near)
        two.append(near + k)
        k += 1
        active = active[left[active] > k]
    for at, n in zip(begin[size > compared].tolist(), size[size > compared].tolist()):
        group = fp[at : at + n]
        free = [x for x in range(64) if int(np.bitwise_or.reduce(group ^ group[0])) >> x & 1]
        single = [np.array(1 << x, np.uint64).astype(np.int64) for x in free]
        for mask in [*single, *(x ^ y for i, x in enumerate(single) for y in single[:i])]:
            wanted = group ^ mask
            place = np.minimum(np.searchsorted(group, wanted), n - 1)
            hit = np.flatnonzero((group[place] == wanted) & (place > np.arange(n)))
            one.append(at + hit)
            two.append(at + place[hit])
    label = united(len(fp), np.concatenate(one), np.concatenate(two))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return pa.table({"a": fp[moved], "b": fp[label[moved]]})


def links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose connected groups are those of all links."""
    spark = classes.sparkSession
    posted = variants(classes)
    met = posted.groupBy("_variant").agg(F.count("*").alias("_n"), F.min("_fp").alias("a"), F.max("_fp").alias("b")).where("_n > 1")
    met = materialize(met, "simhash-variants")
    pairs = met.where((F.col("_n") == 2) & (apart(F.col("a"), F.col("b")) <= BITS)).select("a", "b")
    many = met.where("_n > 2").select(F.col("_variant").alias("_wanted"), "_n")
    n, rows = many.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if not n:
        return pairs
    wanted = F.broadcast(many) if n <= FEW_KEYS else many
    dealt = slots(posted.join(wanted, F.col("_variant") == F.col("_wanted")).select("_variant", "_fp"))
    parts = max(partitions(spark), len(PIECES) * rows // SLOT_ROWS + 1)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("_slot"), F.lit(parts)))
    found = dealt.groupBy("part").applyInArrow(lambda part: freed(linked(part)), LINKS)
    return pairs.unionByName(found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Per row: the id, the columns ``keep``, fingerprint (16 hex digits) and component_id, the least id that links lead to.

    Null, empty and blank texts have fingerprint 0 and are linked like any other; long texts count whole; repeated rows are documents of
    their own and linked, since equal fingerprints are. A null id is no least id: a component without any other has the id null. An
    empty table gives no rows. Columns to keep travel under names of their own, so theirs can't clash.
    """
    keep = keep or []
    signed = materialize(fingerprints(docs, id_col, text_col, shingle, seed, keep), "simhash-signed")
    classes = materialize(signed.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count("*").alias("_rows")), "simhash-classes")
    labels = components(links(classes.select("_fp")), "simhash-components").withColumnRenamed("_key", "_label_fp")
    named = classes.join(labels, F.col("_fp") == F.col("_label_fp"), "left").select("_fp", "_least", "_rows", F.coalesce("_label", "_fp").alias("_root"))
    named = materialize(named, "simhash-labelled")
    least = named.groupBy(F.col("_root").alias("_of")).agg(F.min("_least").alias("component_id"), F.count("*").alias("_classes"))
    named = materialize(join_hot(named, ["_root"], least, ["_of"], "_classes").select(F.col("_fp").alias("_class"), "_rows", "component_id"), "simhash-named")
    whole = join_hot(signed, ["_fp"], named, ["_class"], "_rows")
    kept = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    return whole.select(F.col("_id").alias(id_col), *kept, F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the near-duplicate component of every document by SimHash."""
    return near_duplicates(table(spark, sf_dir, "documents"))
