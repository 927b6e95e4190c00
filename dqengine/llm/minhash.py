"""MinHash near-dedup by an inverted join on signature coordinates.

A document is the set of its distinct word shingles. Documents of one word sequence (told by its SHA-256) are one class from
the start. Every class is posted under each (coordinate, value) pair of its MinHash signature. Pairs with at least ``matches``
common postings are candidates: postings that nothing else has are dropped, a class with fewer than ``matches`` others has no
candidate, and of the rest only the rarest ``c - matches + 1`` are joined (two classes with enough common postings share one of
those, so the frequent postings are skipped). Inside a posting list collisions of whole signatures are counted; a class that has
joined the others is not counted again, so a list yields a spanning forest of its candidates and never all its pairs.

Candidates that hang together are then compared on their full sets. What is compared there are words: shingles are numbered in
each group from the words themselves, hashes only find candidates. Every link that joins two groups is confirmed by
100 * intersection >= percent * union. Components of confirmed links follow from min-label stars in a few joins. With 64
coordinates and 36 matches a pair of similarity 0.8 is missed with probability about 4e-6, a pair of 0.85 with 1e-9.

Long lists and large clusters are split into blocks by a hash. In a block every member goes to a star: a centre that it is near
to. Both distances (coordinates that differ; 1 - similarity) obey the triangle inequality, so stars whose centres lie further
apart than the limit and both radii have no link between them. Centres of all blocks meet; only members of stars that their
centres leave open and that nothing else has joined are compared one by one. So a group of many copies costs its members
once and its few centres again. Only centres, and what is left open at the end, need pairs of blocks.

Null and empty texts have no shingles and are linked with nothing; with fewer words than a shingle the whole sequence is one.
Rows that repeat an id, or have none, are documents of their own; equal rows are one class, of which the first in order of id
and text is kept. Very long texts are read whole, one at a time; an empty table gives no rows; columns to keep travel under
names of their own, so theirs can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqengine.llm import windows as W
from dqengine.llm.common import FEW_KEYS, LOWER, freed, join_hot, materialize, struct_of, table, text_slices, utf8

COORDINATES = 64
MATCHES = 36
LIST_BLOCK = 1024
"""Members of a posting list that meet in one group; longer lists are split."""
SET_BLOCK = 512
"""Members of a candidate cluster whose sets meet in one group."""
CLOSE = 8
"""Coordinates in which a member of a long list may differ from its star's centre."""
FREQUENT = 64
"""Classes of a posting from which on all count as equally frequent."""
SEED = 99

_LOWER = np.frombuffer(LOWER, np.uint8)


def shingle_codes(ids: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, text, start) of all shingles of texts of numbered words; codes are equal where the shingles' words are."""
    n = np.diff(begin)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    start = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) + begin[text]
    length = np.minimum(size, n[text])
    bits = (int(ids.max(initial=0)) + 2).bit_length()
    code, used = np.zeros(len(start), np.uint64), 0
    for j in range(size):
        if used + bits > 64:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            used = len(code).bit_length()
        word = np.where(j < length, ids[np.minimum(start + j, len(ids) - 1)] + np.uint64(1), np.uint64(0)) if len(ids) else code
        code = code << np.uint64(bits) | word
        used += bits
    return code, text, start


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of the distinct shingles of many texts, where each text's begin, and the SHA-256 of each text's word sequence."""
    words = W.Words.of(_LOWER[raw] if len(raw) else raw, at)
    (ids, known), begin = words.numbered(), words.begin
    n = np.diff(begin)
    code, text, start = shingle_codes(ids, begin, size)
    order = np.argsort(code, kind="stable")
    order = order[np.argsort(text[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]  # 16 bits are sorted by radix
    order = order[W.heads(text[order], code[order])]
    text, start = text[order], start[order]
    hashes = W.word_hashes(known)
    length = np.minimum(size, n[text])
    h = length.astype(np.uint64)
    for j in range(size):
        word = hashes[ids[np.minimum(start + j, len(ids) - 1)].astype(np.int64)] if len(ids) else h
        h = h * np.uint64(W.BASES[0]) + np.where(j < length, word, np.uint64(0))
    digests = [hashlib.sha256(words.cut(a, b)).digest() for a, b in zip(begin.tolist(), begin[1:].tolist())]
    return W.mixed(h), np.searchsorted(text, np.arange(len(n) + 1)), digests


def multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(h: np.ndarray, at: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """(texts, k) uint32: least hash of each text's shingles under each of k functions; texts without any get the largest."""
    n = len(at) - 1
    out = np.full((n, k), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for i, a in enumerate(multipliers(k)):
            x = h * a
            x ^= x >> np.uint64(29)
            x *= a
            out[full, i] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), at[:-1][full])
    return out


SIGNED = struct_of("_key long, _class binary, _n int, _sig binary")


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(_key, digest of the word sequence, size of the set, its signature) of documents (_key, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_text", 1 << 20):
            h, at, digests = shingle_sets(*utf8(part.column("_text")), shingle)
            sig = signatures(h, at)
            yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(digests, pa.binary()), pa.array(np.diff(at).astype(np.int32)), pa.array([row.tobytes() for row in sig], pa.binary())], SIGNED.names)

    return docs.select("_key", "_text").mapInArrow(run, SIGNED)


POSTED = struct_of("part int, token binary, key binary, weight binary, own binary")
SHARED = struct_of("_key long, _token long, _df int")


def shared_postings(classes: DataFrame, parts: int) -> DataFrame:
    """(_key, _token, _df) of the postings that more than one class has, _df up to ``FREQUENT``. A posting that is frequent inside a
    pack of classes is sent to its token's part once, with its weight; its members travel in rows that are dealt evenly."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                rows = batch.slice(a, 20_000)
                sig = np.frombuffer(b"".join(rows.column("_sig").to_pylist()), np.uint32).reshape(rows.num_rows, -1)
                token = W.mixed(sig.astype(np.uint64) | np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32)).ravel()
                key = np.repeat(rows.column("_key").to_numpy(zero_copy_only=False), sig.shape[1])
                order = np.argsort(token, kind="stable")
                token, key = token[order], key[order]
                head = W.heads(token)
                size = np.diff(np.r_[head, len(token)])
                frequent = np.repeat(size >= FREQUENT, size)
                lead = np.zeros(len(token), bool)
                lead[head] = True
                sent = np.flatnonzero(~frequent | lead)
                weight = np.where(frequent[sent], FREQUENT, 1).astype(np.int64)
                for chosen, weights, part in ((sent, weight, token[sent]), (np.flatnonzero(frequent), None, W.mixed(key[frequent].astype(np.uint64)))):
                    if len(chosen):
                        dealt = W.by_part((part % np.uint64(parts)).astype(np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([p for p, _ in dealt], pa.int32()),
                                pa.array([token[chosen[o]].tobytes() for _, o in dealt], pa.binary()),
                                pa.array([W.planes(key[chosen[o]]) for _, o in dealt], pa.binary()),
                                pa.array([W.planes(weights[o]) if weights is not None else None for _, o in dealt], pa.binary()),
                                pa.array([b"" for _ in dealt], pa.binary()),
                            ],
                            POSTED.names,
                        )

    def count(rows: pa.Table) -> pa.Table:
        local = rows.filter(rows["weight"].is_null())  # known to be frequent
        rows = rows.filter(rows["weight"].is_valid())
        token = np.frombuffer(b"".join(rows["token"].to_pylist()), np.uint64)
        key = np.concatenate([W.from_planes(k, np.int64) for k in rows["key"].to_pylist()] or [np.zeros(0, np.int64)])
        weight = np.concatenate([W.from_planes(k, np.int64) for k in rows["weight"].to_pylist()] or [np.zeros(0, np.int64)])
        order = np.argsort(token, kind="stable")
        token, key, weight = token[order], key[order], weight[order]
        head = W.heads(token)
        total = np.repeat(np.add.reduceat(weight, head) if len(head) else weight, np.diff(np.r_[head, len(token)]))
        many = (total > 1) & (weight == 1)
        found = [(key[many], token[many], np.minimum(total[many], FREQUENT))]
        for k, t in zip(local["key"].to_pylist(), local["token"].to_pylist()):
            keys = W.from_planes(k, np.int64)
            found.append((keys, np.frombuffer(t, np.uint64), np.full(len(keys), FREQUENT)))
        key, token, df = (np.concatenate(x) for x in zip(*found))
        return pa.table({"_key": pa.array(key), "_token": pa.array(token.view(np.int64)), "_df": pa.array(df.astype(np.int32))})

    return classes.select("_key", "_sig").mapInArrow(post, POSTED).groupBy("part").applyInArrow(lambda rows: freed(count(rows)), SHARED)


EDGES = struct_of("a long, b long")
STARS = struct_of("a long, b long, far double, group long")
"""Edges; for members of blocks also how far b is from its centre a (the centre has an edge to itself) and in which group."""


def _stars_table(pairs: list[tuple]) -> pa.Table:
    columns = list(zip(*pairs)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], STARS.names)


def by_groups(rows: pa.Table, names: tuple[str, ...]) -> Iterator[np.ndarray]:
    """Row numbers of each group of equal values in the named columns."""
    columns = [rows[n].to_numpy() for n in names]
    order = np.lexsort(columns[::-1])
    edge = W.heads(*(c[order] for c in columns))
    yield from np.split(order, edge[1:])


def colliding(rows: pa.Table, matches: int, similarity: float, close: int = CLOSE) -> pa.Table:
    """Spanning forests of the candidates of posting lists: breadth first, each class compared with those not yet reached. Lists
    of more than one block give stars of close members."""
    key, n, blocks = rows["_key"].to_numpy(), rows["_n"].to_numpy().astype(np.int64), rows["_blocks"].to_numpy()
    token = rows["_token"].to_numpy()
    sig = np.frombuffer(b"".join(rows["_sig"].to_pylist()), np.uint32).reshape(len(key), -1)
    pairs: list[tuple] = []
    twos: list[np.ndarray] = []
    for group in by_groups(rows, ("_token", "_block")):
        if len(group) == 2 and blocks[group[0]] == 1:
            twos.append(group)
            continue
        split = blocks[group[0]] > 1
        least = sig.shape[1] - close if split else matches
        rest = group
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            if split:
                pairs.append((int(key[queue[0]]), int(key[queue[0]]), 0.0, int(token[queue[0]])))
            while queue and len(rest):
                x = queue.pop()
                same = (sig[rest] == sig[x]).sum(1)
                near = (same >= least) & (np.minimum(n[rest], n[x]) >= similarity * np.maximum(n[rest], n[x]))
                if near.any():
                    if split:
                        pairs.extend((int(key[x]), int(key[y]), float(sig.shape[1] - m), int(token[x])) for y, m in zip(rest[near], same[near]))
                    else:
                        pairs.extend((int(key[x]), int(key[y]), None, None) for y in rest[near])
                        queue.extend(rest[near])
                    rest = rest[~near]
    if twos:
        x, y = np.stack(twos, 1)
        near = ((sig[x] == sig[y]).sum(1) >= matches) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]))
        pairs.extend((a, b, None, None) for a, b in zip(key[x[near]].tolist(), key[y[near]].tolist()))
    return _stars_table(pairs)


def centres_colliding(rows: pa.Table, matches: int, similarity: float) -> pa.Table:
    """Spanning forests of the centres of long lists whose stars may hold a candidate pair between them."""
    key, n, far = rows["_key"].to_numpy(), rows["_n"].to_numpy().astype(np.int64), rows["_far"].to_numpy()
    sig = np.frombuffer(b"".join(rows["_sig"].to_pylist()), np.uint32).reshape(len(key), -1)
    pairs: list[tuple] = []
    for group in by_groups(rows, ("_token", "_i", "_j")):
        rest = group
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = ((sig[rest] == sig[x]).sum(1) >= matches - far[rest] - far[x]) & (np.minimum(n[rest], n[x]) >= similarity**3 * np.maximum(n[rest], n[x]))
                pairs.extend((int(key[x]), int(key[y]), None, None) for y in rest[near])
                queue.extend(rest[near])
                rest = rest[~near]
    return _stars_table(pairs)


def in_blocks(rows: DataFrame, group: str, block: int, parts: int) -> DataFrame:
    """Deals the members of groups (_size members each) into blocks; ``part`` gathers whole (group, block) units."""
    blocks = F.ceil(F.col("_size") / F.lit(block)).cast("int")
    dealt = rows.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("_key", group), blocks).cast("int"))
    return dealt.withColumn("part", F.pmod(F.xxhash64(group, "_block"), F.lit(parts)).cast("int"))


def in_pairs_of_blocks(rows: DataFrame, group: str, block: int, parts: int) -> DataFrame:
    """The same for centres, which go to all pairs of blocks that their block is in."""
    blocks = F.ceil(F.col("_size") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("_key", group), blocks).cast("int")
    dealt = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("_i", F.least("_mine", "_other")).withColumn("_j", F.greatest("_mine", "_other")).drop("_other")
    return dealt.withColumn("part", F.pmod(F.xxhash64(group, "_i", "_j"), F.lit(parts)).cast("int"))


def sized(rows: DataFrame, group: str) -> DataFrame:
    """rows with _size, how many of them are in their group; groups of one go."""
    sizes = rows.groupBy(F.col(group).alias("_sized")).agg(F.count("*").alias("_size")).where("_size > 1")
    return join_hot(rows, [group], sizes, ["_sized"], "_size")


def centres_of(stars: DataFrame) -> DataFrame:
    """(_key, group, _far, _size): centres of stars, their radius, and how many centres their group has."""
    found = stars.where("far is not null").groupBy(F.col("group"), F.col("a").alias("_key")).agg(F.max("far").alias("_far"))
    sizes = found.groupBy(F.col("group").alias("_sized")).agg(F.count("*").alias("_size"))
    return found.join(sizes, F.col("group") == F.col("_sized")).drop("_sized")


def candidates(classes: DataFrame, matches: int, similarity: float, parts: int) -> DataFrame:
    """Edges (a, b) between classes whose connected groups hold every candidate pair."""
    shared = shared_postings(classes, parts)
    posts = shared.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_df", "_token"))).alias("_posts"))
    prefix = F.slice("_posts", 1, F.size("_posts") - F.lit(matches - 1))
    kept = posts.where(F.size("_posts") >= matches).select(F.col("_key").alias("_post_key"), F.explode(prefix).alias("_post")).select("_post_key", F.col("_post._token").alias("_token"))
    kept = sized(materialize(kept, "minhash-prefixes"), "_token")
    joined = classes.join(kept, F.col("_key") == F.col("_post_key")).select("_key", "_n", "_sig", "_token", "_size")
    close = CLOSE
    found = in_blocks(joined, "_token", LIST_BLOCK, parts).groupBy("part").applyInArrow(lambda rows: freed(colliding(rows, matches, similarity, close)), STARS)
    found = materialize(found, "minhash-lists")
    edges = found.select("a", "b")
    if not found.where("far is not null").isEmpty():
        centres = centres_of(found).withColumnRenamed("_key", "_centre").withColumnRenamed("group", "_token")
        met = classes.join(centres, F.col("_key") == F.col("_centre")).select("_key", "_n", "_sig", "_token", "_far", "_size")
        more = in_pairs_of_blocks(met, "_token", LIST_BLOCK, parts).groupBy("part").applyInArrow(lambda rows: freed(centres_colliding(rows, matches, similarity)), STARS)
        edges = edges.unionByName(more.select("a", "b"))
    return edges


def _stars(edges: DataFrame) -> bool:
    """Whether every a has one b and no b is an a."""
    ends = edges.select(F.col("a").alias("k"), F.lit(1).alias("n"), F.lit(0).alias("hub")).unionByName(edges.select(F.col("b").alias("k"), F.lit(0).alias("n"), F.lit(1).alias("hub")))
    return ends.groupBy("k").agg(F.sum("n").alias("n"), F.max("hub").alias("hub")).where("n > 1 or (n = 1 and hub = 1)").isEmpty()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(_key, _label): the least key reachable by edges (a, b), for every key that has an edge. Large-star and small-star
    steps in turn until only stars are left; each is an aggregation and a join in which hubs are broadcast, so no
    neighbourhood is ever gathered."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    least = lambda df: df.groupBy(F.col("a").alias("_at")).agg(F.least(F.min("b"), F.col("_at")).alias("_m"), F.count("*").alias("_n"))
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = join_hot(both, ["a"], least(both), ["_at"], "_n").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), name)
        small = large.groupBy(F.col("a").alias("_at")).agg(F.min("b").alias("_m"), F.count("*").alias("_n"))
        step = join_hot(large, ["a"], small, ["_at"], "_n").select(F.col("b").alias("x"), F.col("_m").alias("y"))
        step = step.unionByName(small.select(F.col("_at").alias("x"), F.col("_m").alias("y"))).where("x <> y")
        now = materialize(step.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), name)
    own = now.groupBy(F.col("a").alias("_key")).agg(F.min("b").alias("_label"))
    return own.unionByName(now.select(F.col("b").alias("_key"), F.col("b").alias("_label")).distinct())


class Sets:
    """Shingle sets of a group, numbered from the words themselves, in order of size."""

    def __init__(self, blobs: list[bytes], shingle: int):
        words = W.Words.of(np.frombuffer(b"".join(blobs), np.uint8), np.r_[0, np.cumsum([len(b) for b in blobs])].astype(np.int64))
        code, text, _ = shingle_codes(words.numbered()[0], words.begin, shingle)
        code = np.unique(code, return_inverse=True)[1]
        order = np.lexsort((code, text))
        order = order[W.heads(text[order], code[order])]
        code, text = code[order], text[order]
        size = np.bincount(text, minlength=len(blobs))
        self.order = np.argsort(size, kind="stable")
        self.size = size[self.order]
        start = np.r_[0, np.cumsum(size)[:-1]][self.order]
        self.edge = np.r_[0, np.cumsum(self.size)]
        self.ids = code[np.arange(self.edge[-1]) + np.repeat(start - self.edge[:-1], self.size)]
        self.flag = np.zeros(int(code.max(initial=0)) + 1, np.int32)

    def common(self, x: int, rest: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set x with others."""
        mine = self.ids[self.edge[x] : self.edge[x + 1]]
        self.flag[mine] = 1
        at = np.r_[0, np.cumsum(self.size[rest])]
        take = np.arange(at[-1]) + np.repeat(self.edge[rest] - at[:-1], self.size[rest])
        found = np.add.reduceat(self.flag[self.ids[take]], at[:-1])
        self.flag[mine] = 0
        return found

    def fitting(self, x: int, percent: int, open_: np.ndarray) -> np.ndarray:
        """Open sets whose size allows a link with x."""
        low = np.searchsorted(self.size * 100, self.size[x] * percent, side="left")
        high = np.searchsorted(self.size * percent, self.size[x] * 100, side="right")
        return low + np.flatnonzero(open_[low:high])


SETS = struct_of("_key long, _cluster long, _size long, _words binary")


def confirmed(rows: pa.Table, shingle: int, percent: int) -> pa.Table:
    """Links between full sets that join two groups, for each cluster; for each block of large ones, stars of linked members."""
    key, blocks, cluster, blobs = rows["_key"].to_numpy(), rows["_blocks"].to_numpy(), rows["_cluster"].to_numpy(), rows["_words"].to_pylist()
    pairs: list[tuple] = []
    for group in by_groups(rows, ("_cluster", "_block")):
        split = blocks[group[0]] > 1
        if len(group) < 2 and not split:
            continue
        sets = Sets([blobs[g] for g in group], shingle)
        group = group[sets.order]
        open_ = np.ones(len(group), bool)
        while open_.any():
            first = int(np.argmax(open_))
            open_[first] = False
            queue = [first]
            if split:
                pairs.append((int(key[group[first]]), int(key[group[first]]), 0.0, int(cluster[group[first]])))
            while queue:
                x = queue.pop()
                rest = sets.fitting(x, percent, open_)
                if not len(rest):
                    continue
                common = sets.common(x, rest)
                union = sets.size[rest] + sets.size[x] - common
                near = 100 * common >= percent * union
                if split:
                    pairs.extend((int(key[group[x]]), int(key[group[y]]), float(d), int(cluster[group[x]])) for y, d in zip(rest[near], 1 - common[near] / union[near]))
                else:
                    pairs.extend((int(key[group[x]]), int(key[group[y]]), None, None) for y in rest[near])
                    queue.extend(rest[near].tolist())
                open_[rest[near]] = False
    return _stars_table(pairs)


def centres_confirmed(rows: pa.Table, shingle: int, percent: int) -> pa.Table:
    """Of the centres of large clusters: links (far null) and pairs of centres whose stars may be linked (far 1)."""
    key, far, blobs = rows["_key"].to_numpy(), rows["_far"].to_numpy(), rows["_words"].to_pylist()
    limit = 1 - percent / 100 + 1e-9
    pairs: list[tuple] = []
    for group in by_groups(rows, ("_cluster", "_i", "_j")):
        if len(group) < 2:
            continue
        sets = Sets([blobs[g] for g in group], shingle)
        group = group[sets.order]
        for x in range(len(group) - 1):
            rest = np.arange(x + 1, len(group))
            common = sets.common(x, rest)
            union = sets.size[rest] + sets.size[x] - common
            linked = 100 * common >= percent * union
            apart = 1 - common / union
            maybe = ~linked & (apart <= limit + far[group[x]] + far[group[rest]])
            pairs.extend((int(key[group[x]]), int(key[group[y]]), None, None) for y in rest[linked])
            pairs.extend((int(key[group[x]]), int(key[group[y]]), 1.0, None) for y in rest[maybe])
    return _stars_table(pairs)


def open_confirmed(rows: pa.Table, shingle: int, percent: int) -> pa.Table:
    """Links between members of stars that nothing else has joined (other labels), for each cluster's pair of blocks."""
    key, label, blobs = rows["_key"].to_numpy(), rows["_label"].to_numpy(), rows["_words"].to_pylist()
    pairs: list[tuple] = []
    for group in by_groups(rows, ("_cluster", "_i", "_j")):
        if len(group) < 2:
            continue
        sets = Sets([blobs[g] for g in group], shingle)
        group = group[sets.order]
        mine = label[group].copy()
        for x in range(len(group)):
            rest = sets.fitting(x, percent, mine != mine[x])
            if len(rest):
                common = sets.common(x, rest)
                for y in rest[100 * common >= percent * (sets.size[rest] + sets.size[x] - common)].tolist():
                    if mine[y] != mine[x]:
                        pairs.append((int(key[group[x]]), int(key[group[y]]), None, None))
                        mine[mine == mine[y]] = mine[x]
    return _stars_table(pairs)


def with_words(docs: DataFrame, keys: DataFrame, key: str, columns: list[str], few: bool = False) -> DataFrame:
    """keys with the normalized words of their documents. ``few``: keys are not many as a rule, such as centres; up to ``FEW_KEYS`` of
    them are broadcast. Others grow with the documents and are joined by merging at every size."""
    side = F.broadcast(keys) if few and keys.count() <= FEW_KEYS else keys.hint("merge")
    joined = docs.join(side, F.col("_key") == F.col(key)).select("_key", "_text", *columns)
    schema = struct_of("_key long, _words binary")
    for c in columns:
        schema.add(joined.schema[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_text", 1 << 20):
            texts = part.column("_text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array([b" ".join(t.translate(LOWER).split()) for t in texts], pa.binary()), *(part.column(c) for c in columns)], schema.names)

    return joined.mapInArrow(run, schema)


def links(docs: DataFrame, clusters: DataFrame, shingle: int, percent: int, parts: int) -> DataFrame:
    """Confirmed edges inside clusters (_key, _label)."""
    members = sized(clusters.select(F.col("_key").alias("_member"), F.col("_label").alias("_cluster")), "_cluster")
    dealt = in_blocks(with_words(docs, members, "_member", ["_cluster", "_size"]), "_cluster", SET_BLOCK, parts)
    found = materialize(dealt.groupBy("part").applyInArrow(lambda rows: freed(confirmed(rows, shingle, percent)), STARS), "minhash-confirmed")
    stars = found.where("far is not null")
    if stars.isEmpty():
        return found.select("a", "b")
    centres = centres_of(stars).withColumnRenamed("_key", "_centre").withColumnRenamed("group", "_cluster")
    met = in_pairs_of_blocks(with_words(docs, centres, "_centre", ["_cluster", "_far", "_size"], few=True), "_cluster", SET_BLOCK, parts)
    more = materialize(met.groupBy("part").applyInArrow(lambda rows: freed(centres_confirmed(rows, shingle, percent)), STARS), "minhash-centres")
    edges = found.select("a", "b").unionByName(more.where("far is null").select("a", "b"))
    maybe = more.where("far is not null").select(F.col("a").alias("_one"), F.col("b").alias("_two")).distinct()
    if maybe.isEmpty():
        return edges
    # Members of stars that may be linked and that nothing else has joined.
    label = components(edges, "minhash-stars")
    one, two = label.select(F.col("_key").alias("_one_key"), F.col("_label").alias("_one_label")), label.select(F.col("_key").alias("_two_key"), F.col("_label").alias("_two_label"))
    sides = maybe.join(one, F.col("_one") == F.col("_one_key"), "left").join(two, F.col("_two") == F.col("_two_key"), "left")
    sides = sides.select("_one", "_two", F.coalesce("_one_label", "_one").alias("_one_label"), F.coalesce("_two_label", "_two").alias("_two_label")).where("_one_label <> _two_label")
    apart = sides.select(F.col("_one").alias("_star"), F.col("_one_label").alias("_label")).unionByName(sides.select(F.col("_two").alias("_star"), F.col("_two_label").alias("_label"))).distinct()
    left = stars.select(F.col("a").alias("_of"), F.col("b").alias("_member"), F.col("group").alias("_cluster")).join(apart, F.col("_of") == F.col("_star"))
    left = sized(materialize(left.select("_member", "_cluster", "_label"), "minhash-open"), "_cluster")
    rows = in_pairs_of_blocks(with_words(docs, left, "_member", ["_cluster", "_label", "_size"], few=True), "_cluster", SET_BLOCK, parts)
    last = rows.groupBy("part").applyInArrow(lambda rows: freed(open_confirmed(rows, shingle, percent)), STARS)
    return edges.unionByName(last.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, matches: int = MATCHES, keep: list[str] | None = None) -> DataFrame:
    """Per row: the id, the columns ``keep``, n_shingles, component_id (the least id that links lead to) and kept (it is that
    document). ``percent`` is the least similarity in hundredths."""
    keep = keep or []
    spark = docs.sparkSession
    parts = W.parts_of(spark)
    base = W.keyed(docs, id_col, text_col, keep)
    every = materialize(signed(base, shingle), "minhash-signed")
    sets = materialize(every.where("_n > 0").groupBy(F.col("_class").alias("_of_class")).agg(F.min("_key").alias("_rep"), F.count("*").alias("_rows")), "minhash-classes")
    classes = every.join(sets.select(F.col("_rep").alias("_r")), F.col("_key") == F.col("_r")).select("_key", "_n", "_sig")
    found = materialize(candidates(classes, matches, percent / 100, parts), "minhash-candidates")
    clusters = materialize(components(found, "minhash-clusters"), "minhash-cluster-labels")
    edges = materialize(links(base, clusters, shingle, percent, parts), "minhash-links")
    labels = components(edges, "minhash-components").select(F.col("_key").alias("_rep_key"), "_label")
    labelled = sets.join(labels, F.col("_rep") == F.col("_rep_key"), "left").select("_of_class", "_rows", F.coalesce("_label", "_rep").alias("_component"))
    labelled = materialize(labelled, "minhash-labelled")
    whole = join_hot(every.where("_n > 0").select("_key", "_class", "_n"), ["_class"], labelled, ["_of_class"], "_rows")
    whole = whole.select("_key", "_n", "_component").unionByName(every.where("_n = 0").select("_key", "_n", F.col("_key").alias("_component")))
    named = whole.select(F.col("_key").alias("_whole_key"), F.col("_n").cast("long").alias("n_shingles"), (F.col("_key") == F.col("_component")).alias("kept"), "_component")
    if W.natural(base):
        named = named.withColumn("component_id", F.col("_component").cast(docs.schema[id_col].dataType))
    else:
        ids = base.select(F.col("_key").alias("_id_key"), F.col("_id").alias("component_id"))
        named = materialize(named, "minhash-whole").join(ids, F.col("_component") == F.col("_id_key"))
    extra = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    return base.join(named, F.col("_key") == F.col("_whole_key")).select(F.col("_id").alias(id_col), *extra, "n_shingles", "component_id", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 4), ' ') AS s
  FROM words, unnest(range(0, greatest(1, len(w) - 3))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a)
SELECT words.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(reach.b) AS component_id, words.doc_id = min(reach.b) AS kept
FROM words LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = words.doc_id GROUP BY words.doc_id
"""
