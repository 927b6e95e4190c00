"""Prefix trie of conversations from mergeable partial tries.

A node is a sequence of first turns. Its name is a polynomial hash of the turns' SHA-256 digests modulo 2**127 - 1, which is a
sum: hashes of stretches of a conversation are put together from those of its parts, so a conversation is dealt out by ranges of
its turns and never gathered, and what stands behind exchanged first turns is renamed by one multiplication.

Partitions emit partial tries, tables of nodes in which their own conversations are already added up. Merges keyed by node add up
``FAN`` partial tries at a time until there is one row a node. Lists of the conversations that end at a node are sorted runs of their
numbers; a list is hashed where it stands, or, where it crosses ranges, streamed past one hash in pieces of ``PIECE`` numbers.

Only nodes with two members or more need a rollup; all others lie on a path to one leaf. It goes from the bottom up in doubling
steps: after k steps a node has the sums of its subtree to depth 2**k, so a trie of any depth takes log(depth) steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqengine.llm.common import free_memory, join_hot, materialize, partitions, struct_of
from dqengine.llm.structure_repair import crc32_sql
from dqengine.llm.turns import TURN_DIGEST_SQL, in_order, turn_digest

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation").digest()[:15])
FIRST = 5
"""Most first turns that are exchanged."""
FAN = 16
NODES = 100_000
"""Nodes of a partial trie that a task holds before it emits them."""
PIECE = 4096
ROOT = bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()


def packed(x: int) -> bytes:
    return x.to_bytes(16)


class Powers:
    """Powers of BASE; those of usual lengths are kept."""

    def __init__(self):
        self.known = [1]

    def __getitem__(self, n: int) -> int:
        if n > 4096:
            return pow(BASE, n, PRIME)
        while len(self.known) <= n:
            self.known.append(self.known[-1] * BASE % PRIME)
        return self.known[n]


STRETCH = "conv_id long, _range integer, rank long, before binary, hash binary, chars long"


def stretches(ordered: DataFrame) -> DataFrame:
    """Turns with their place in what a range has of their conversation, and the hashes of that stretch before and after them."""
    schema = struct_of(STRETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, rank, value = None, 0, 0
        for batch in batches:
            ranks, before, after = [], [], []
            for c, digest in zip(batch.column("conv_id").to_pylist(), batch.column("_digest").to_pylist()):
                if c != conv:
                    conv, rank, value = c, 0, 0
                rank += 1
                before.append(packed(value))
                value = (value * BASE + int(digest[:32], 16)) % PRIME
                ranks.append(rank)
                after.append(packed(value))
            columns = [batch.column("conv_id"), batch.column("_range"), pa.array(ranks, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary()), batch.column("chars")]
            yield pa.RecordBatch.from_arrays(columns, schema.names)
        free_memory()

    return ordered.select("conv_id", "_range", "_digest", "chars").mapInArrow(run, schema)


def profiles(rows: DataFrame) -> DataFrame:
    """Per conversation: _ranges (range, turns, hash of its stretches in order) and _first, the first turns of its stretches."""
    last = rows.groupBy("conv_id", "_range").agg(F.max_by(F.struct("rank", "hash"), "rank").alias("_l"))
    last = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_range", F.col("_l.rank").alias("n"), F.col("_l.hash").alias("hash")))).alias("_ranges"))
    first = rows.where(F.col("rank") <= FIRST).groupBy(F.col("conv_id").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("_range", "rank", "hash", "chars"))).alias("_first"))
    return last.join(first, F.col("conv_id") == F.col("_c")).drop("_c")


def heads(ranges: list[dict], first: list[dict], powers: Powers) -> tuple[list[int], list[int]]:
    """Hashes and code points of the first turns, up to FIRST of them; the hash of none leads."""
    hashes, chars, before = [0], [], 0
    for r in ranges:
        for turn in first:
            if turn["_range"] == r["_range"] and len(chars) < FIRST:
                hashes.append((before * powers[turn["rank"]] + int.from_bytes(turn["hash"])) % PRIME)
                chars.append(turn["chars"])
        before = (before * powers[r["n"]] + int.from_bytes(r["hash"])) % PRIME
        if len(chars) == FIRST:
            break
    return hashes, chars


NODE = "hash binary, parent binary, depth long, n_convs long, least long, chars long, goes_on integer, slot integer"


class Partial:
    """A partial trie: members, least member and whether any goes on, for each node that a task has met."""

    def __init__(self, slot: int):
        self.nodes, self.slot = {}, slot

    def add(self, hash_: bytes, parent: bytes | None, depth: int, conv: int, chars: int, goes_on: bool) -> None:
        node = self.nodes.get(hash_)
        if node is None:
            self.nodes[hash_] = [parent, depth, 1, conv, chars, int(goes_on)]
        else:
            node[2] += 1
            node[3] = min(node[3], conv)
            node[5] |= goes_on

    def emitted(self, schema) -> pa.RecordBatch:
        columns = list(zip(*self.nodes.values())) if self.nodes else [[]] * 6
        kinds = [pa.binary(), *[pa.int64()] * 4, pa.int32()]
        arrays = [pa.array(list(self.nodes), pa.binary()), *(pa.array(c, t) for c, t in zip(columns, kinds)), pa.array([self.slot] * len(self.nodes), pa.int32())]
        self.nodes = {}
        return pa.RecordBatch.from_arrays(arrays, schema.names)


PLAN = "conv_id long, range integer, turns_before long, hash_before binary, h long, k long, shift binary, total long"


def exchanged(members: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From conversations with their base's profile: partial tries of root and exchanged turns, (hash, conv_id) of every end, and the
    plan by which own turns are renamed. ``h`` turns are exchanged for the base's first ones."""
    node, plan, ends = struct_of(NODE), struct_of(PLAN), struct_of("hash binary, conv_id long")

    def read(batch: pa.RecordBatch, powers: Powers):
        for row in batch.to_pylist():
            h, conv = row["_h"], row["conv_id"]
            base, chars = heads(row["_base_ranges"] or [], row["_base_first"] or [], powers)
            own, _ = heads(row["_ranges"], row["_first"], powers)
            n, k = sum(r["n"] for r in row["_ranges"]), min(h, len(chars))
            shift = (base[k] - own[min(h, n)]) % PRIME
            yield conv, h, n, k, shift, base, chars, row["_ranges"]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, partial = Powers(), None
        for batch in batches:
            partial = partial or Partial(batch.column("_part")[0].as_py())
            for conv, h, n, k, _, base, chars, _ in read(batch, powers):
                total = k + max(0, n - h)
                for d in range(k + 1):
                    partial.add(packed(base[d]), packed(base[d - 1]) if d else None, d, conv, chars[d - 1] if d else 0, d < total)
            if len(partial.nodes) > NODES:
                yield partial.emitted(node)
        if partial is not None:
            yield partial.emitted(node)

    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            hashes, convs = [], []
            for conv, h, n, k, shift, base, _, ranges in read(batch, powers):
                value = 0
                for r in ranges:
                    value = (value * powers[r["n"]] + int.from_bytes(r["hash"])) % PRIME
                hashes.append(packed((value + shift * powers[n - h]) % PRIME if n > h else base[k]))
                convs.append(conv)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(convs, pa.int64())], ends.names)

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out = []
            for conv, h, n, k, shift, _, _, ranges in read(batch, powers):
                value, before = 0, 0
                for r in ranges:
                    if before + r["n"] > h:
                        out.append((conv, r["_range"], before, packed(value), h, k, packed(shift), n))
                    value, before = (value * powers[r["n"]] + int.from_bytes(r["hash"])) % PRIME, before + r["n"]
            columns = list(zip(*out)) if out else [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], plan.names)

    return members.withColumn("_part", F.spark_partition_id()).mapInArrow(nodes, node), members.mapInArrow(ending, ends), members.mapInArrow(planned, plan)


def own_nodes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Partial tries of the turns that conversations keep."""
    node = struct_of(NODE)
    met = rows.join(plan.withColumnRenamed("conv_id", "_c"), (F.col("conv_id") == F.col("_c")) & (F.col("_range") == F.col("range")))
    met = met.where(F.col("turns_before") + F.col("rank") > F.col("h")).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, partial, number = Powers(), None, int.from_bytes
        for batch in batches:
            partial = partial or Partial(batch.column("_part")[0].as_py())
            for r in batch.to_pylist():
                place, stretch, shift = r["turns_before"] + r["rank"], number(r["hash_before"]), number(r["shift"])
                own = place - r["h"]
                hash_ = (stretch * powers[r["rank"]] + number(r["hash"]) + shift * powers[own]) % PRIME
                parent = (stretch * powers[r["rank"] - 1] + number(r["before"]) + shift * powers[own - 1]) % PRIME
                partial.add(packed(hash_), packed(parent), r["k"] + own, r["conv_id"], r["chars"], place < r["total"])
                if len(partial.nodes) > NODES:
                    yield partial.emitted(node)
        if partial is not None:
            yield partial.emitted(node)

    columns = ["conv_id", "rank", "before", "hash", "chars", "turns_before", "hash_before", "h", "k", "shift", "total", "_part"]
    return met.select(*columns).mapInArrow(run, node)


def merged(partial: DataFrame) -> DataFrame:
    """One row a node: partial tries are added up by node, FAN of them at a time."""
    slots = (partial.agg(F.max("slot")).first()[0] or 0) + 1
    while True:
        slots = (slots + FAN - 1) // FAN
        partial = partial.groupBy("hash", (F.floor(F.col("slot") / FAN).cast("int") if slots > 1 else F.lit(0)).alias("slot")).agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("least").alias("least"), F.first("chars").alias("chars"), F.max("goes_on").alias("goes_on")
        )
        if slots == 1:
            return partial.drop("slot")


def end_digests(ends: DataFrame) -> DataFrame:
    """(_end, ends_sha256) of every node at which conversations end."""
    ordered = ends.repartitionByRange(partitions(ends.sparkSession), "hash", "conv_id").sortWithinPartitions("hash", "conv_id")
    piece = struct_of("hash binary, first long, list string, ends_sha256 string")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists inside a range are hashed; the first and the last one, and those over a piece, go on in pieces."""
        out, now, numbers, whole = [], None, [], False

        def close(done: bool):
            text = ",".join(map(str, numbers))
            out.append((now, numbers[0], None, hashlib.sha256(text.encode()).hexdigest()) if done else (now, numbers[0], text, None))

        def flush():
            columns = list(zip(*out)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string(), pa.string()))], piece.names)

        for batch in batches:
            for hash_, conv in zip(batch.column("hash").to_pylist(), batch.column("conv_id").to_pylist()):
                if hash_ != now:
                    if numbers:
                        close(whole)
                    whole, now, numbers = now is not None, hash_, []
                if len(numbers) == PIECE:
                    close(False)
                    whole, numbers = False, []
                numbers.append(conv)
            yield flush()
            out = []
        if numbers:
            close(False)
            yield flush()

    found = materialize(ordered.mapInArrow(runs, piece), "trie-ends")
    open_ = found.where("list is not null").repartition(partitions(ends.sparkSession), "hash").sortWithinPartitions("hash", "first")
    done = struct_of("hash binary, ends_sha256 string")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for hash_, text in zip(batch.column("hash").to_pylist(), batch.column("list").to_pylist()):
                if hash_ != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = hash_, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], done.names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], done.names)

    return found.where("list is null").select("hash", "ends_sha256").unionByName(open_.select("hash", "list").mapInArrow(joined, done)).withColumnRenamed("hash", "_end")


def rolled_up(shared: DataFrame) -> DataFrame:
    """(_rolled, n_leaves, saved_tokens) of nodes (hash, parent, depth, leaves, saved) from sums over their subtrees."""
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    now = materialize(shared.select("hash", F.col("parent").alias("up"), "leaves", "saved"), "trie-rollup")
    for _ in range(int(deepest).bit_length()):
        adds = now.where("up is not null").groupBy(F.col("up").alias("_to")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"), F.count("*").alias("_below"))
        # Every node that another one leads to, with the node that it leads to itself.
        met = adds.join(now, F.col("_to") == F.col("hash")).select("_to", F.col("up").alias("_up"), "_below")
        further = join_hot(now.where("up is not null").select("hash", "up"), ["up"], met, ["_to"], "_below").select(F.col("hash").alias("_h"), "_up")
        step = now.join(adds, F.col("hash") == F.col("_to"), "left").join(further, F.col("hash") == F.col("_h"), "left")
        added = lambda c: (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c)
        now = materialize(step.select("hash", F.col("_up").alias("up"), added("leaves"), added("saved")), "trie-rollup")
    return now.select(F.col("hash").alias("_rolled"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def own_first_turns(conv_id):
    """How many first turns of a conversation are exchanged."""
    return F.crc32(conv_id.cast("string")) % 6


def trie(turns: DataFrame, rebuilt: bool = True) -> DataFrame:
    """Per node of the trie of all conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    ``rebuilt``: the first h turns of a conversation c are exchanged for those of c - c % 100, h being CRC-32 of c modulo 6. Without it
    conversations stand as they are.

    Turns stand by turn (null first), turns of one number by their digest; equal rows are turns of their own. A null role or text is
    empty; long texts count whole. conv_id is a whole number; rows without one belong to no conversation. An empty table has no
    conversations and no nodes. Other columns are left alone, whatever they are called.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("_digest"), F.char_length(text).cast("long").alias("chars"))
    rows = materialize(stretches(in_order(rows)), "trie-stretches")
    convs = materialize(profiles(rows), "trie-profiles")
    h = own_first_turns(F.col("conv_id")) if rebuilt else F.lit(0).cast("long")
    bases = convs.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("_base"), F.col("_ranges").alias("_base_ranges"), F.col("_first").alias("_base_first"))
    members = convs.withColumn("_h", h).withColumn("_of", F.col("conv_id") - F.col("conv_id") % 100)
    members = materialize(members.join(bases, F.col("_of") == F.col("_base"), "left").drop("_base"), "trie-members")
    first, ends, plan = exchanged(members, FIRST)
    partial = materialize(first.unionByName(own_nodes(rows, plan)), "trie-partial")
    nodes = materialize(merged(partial), "trie-nodes")

    shared = nodes.where("n_convs > 1 or depth = 0")
    above = shared.select(F.col("hash").alias("_above"), F.col("least").alias("_parent_least"))
    attached = materialize(nodes.join(above, F.col("parent") == F.col("_above"), "left").drop("_above"), "trie-attached")
    kids = attached.where("_parent_least is not null").groupBy(F.col("parent").alias("_of")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("_single"))
    shared = attached.where("n_convs > 1 or depth = 0").join(kids, F.col("hash") == F.col("_of"), "left")
    number = F.coalesce(F.col("n_children"), F.lit(0))
    shared = shared.select(
        "hash", "parent", "depth", "n_convs", "least", "_parent_least", number.alias("n_children"), (F.coalesce("_single", F.lit(0)) + (number == 0).cast("long")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    )
    shared = materialize(shared, "trie-shared")
    sums, digests = rolled_up(shared), end_digests(ends)
    shared = shared.join(sums, F.col("hash") == F.col("_rolled")).join(digests, F.col("hash") == F.col("_end"), "left")
    whole = shared.select(F.col("least").alias("conv_id"), "depth", F.col("_parent_least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    # A node of one member below the root: its subtree is a path to the one leaf.
    single = attached.where("n_convs = 1 and depth > 0").select(
        F.col("least").alias("conv_id"), "depth", F.coalesce("_parent_least", "least").alias("parent_conv_id"), "n_convs", F.col("goes_on").cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("goes_on") == 1, F.lit(EMPTY)).otherwise(F.sha2(F.col("least").cast("string"), 256)).alias("ends_sha256"),
    )
    return whole.unionByName(single)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the trie of all rebuilt conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {TURN_DIGEST_SQL}) AS i, {TURN_DIGEST_SQL} AS digest, length(text) AS chars FROM given),
convs AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS name FROM given),
heads AS (SELECT conv_id, {crc32_sql("name")} % 6 AS h FROM convs),
turns AS (
  SELECT h.conv_id, 0 AS own, p.i, p.digest, p.chars FROM heads h JOIN placed p ON p.conv_id = h.conv_id - h.conv_id % 100 AND p.i <= h.h
  UNION ALL
  SELECT h.conv_id, 1, p.i, p.digest, p.chars FROM heads h JOIN placed p ON p.conv_id = h.conv_id AND p.i > h.h),
steps AS (SELECT conv_id, digest, chars, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth FROM turns),
paths AS (
  SELECT conv_id, depth, chars, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM steps
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS total FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = total), '')) AS ends_sha256
  FROM paths JOIN lengths USING (conv_id) GROUP BY path),
kids AS (SELECT path[1:64 * (depth - 1)] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT p.path, s.depth - p.depth AS apart, s.saved, k.path IS NULL AS leaf
  FROM (SELECT s.path, unnest(range(0, s.depth + 1)) AS d FROM nodes s) x JOIN nodes s ON s.path = x.path JOIN nodes p ON p.path = x.path[1:64 * d]
  LEFT JOIN kids k ON k.path = s.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:64 * (n.depth - 1)] LEFT JOIN kids k ON k.path = n.path
JOIN (SELECT path, (count(*) FILTER (leaf))::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY path) b ON b.path = n.path
"""
