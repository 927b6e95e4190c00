"""SimHash components against all pairs of fingerprints, and fingerprints against their definition."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from dqengine.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_labels(fps):
    label = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def ball(rng, centre, n, radius):
    return [centre ^ int(np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, radius + 1), replace=False).astype(np.uint64), initial=np.uint64(0))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    made = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, 150)]
        for _ in range(rng.integers(1, 9)):
            words = list(base)
            for j in rng.integers(0, 150, rng.integers(0, 4)):
                words[j] = f"W{rng.integers(0, 9)}É"
            made.append(" ".join(words))
    return [*made, None, "", " \t\x0b", "one", "ONE", "one two", "one two three", "a a a a a a", "\x1c two\u0085 three  four", "x " * 70_000, "日本 語 テキ スト"]


def test_fingerprints_follow_their_definition(texts):
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_native_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("one two three é",)], "t string").select(F.xxhash64("t")).first()
    assert row[0] % (1 << 64) == xxhash.xxh64_intdigest("one two three é".encode(), 42)


def test_components_are_those_of_all_pairs(spark, texts):
    rows = [(i * 2 - 5, t, i) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp int").repartition(3)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs, keep=["_fp"]).collect()}
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    label = slow_labels(fps)
    assert len(found) == len(rows)
    for (i, _, extra), fp, low in zip(rows, fps, label):
        assert (found[i].fingerprint, found[i].component_id, found[i]._fp) == (f"{fp:016x}", rows[low][0], extra)


@pytest.mark.parametrize("compared", [2048, 3])
def test_links_of_crowded_and_of_scattered_fingerprints(spark, monkeypatch, compared):
    rng = np.random.default_rng(11)
    word = lambda: int(rng.integers(0, 1 << 63)) * 2 + 1
    fps = {0, (1 << 64) - 1, 1 << 63, 3}
    for radius, n in ((1, 60), (2, 200), (3, 250), (5, 150)):
        fps |= set(ball(rng, word(), n, radius))
    half = word() & 0xFFFFFFFF
    fps |= {half | int(x) << 32 for x in rng.integers(0, 1 << 32, 80)} | {half << 32 | int(x) for x in rng.integers(0, 1 << 9, 80)}
    fps = sorted(fps)
    rng.shuffle(fps)
    classes = spark.createDataFrame([(signed(x),) for x in fps], "_fp long")
    dealt = simhash.slots(simhash.variants(classes)).toArrow()
    edges = simhash.linked(dealt, compared=compared).to_pylist() if compared == 3 else simhash.links(classes).collect()
    place = {signed(x): i for i, x in enumerate(fps)}
    label = simhash.united(len(fps), np.array([place[e["a"]] for e in edges]), np.array([place[e["b"]] for e in edges]))
    assert label.tolist() == slow_labels(fps)
    assert len(edges) < 6 * 64 * len(fps)


def test_every_link_shares_a_variant(spark):
    rng = np.random.default_rng(2)
    pairs = [(x := int(rng.integers(0, 1 << 63)), x ^ (1 << int(i)) ^ (1 << int(j))) for i, j in rng.integers(0, 64, (200, 2))]
    found = simhash.variants(spark.createDataFrame([(signed(y),) for p in pairs for y in p], "_fp long")).collect()
    at = {}
    for r in found:
        at.setdefault(r._fp, set()).add(r._variant)
    assert all(at[signed(a)] & at[signed(b)] for a, b in pairs)
    assert {len(v) for v in at.values()} == {64}


def test_odd_tables(spark):
    schema = "doc_id string, text string, component_id int"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    docs = spark.createDataFrame([("b", "one two three four", 1), ("a", "one two three four", 2), (None, "one two three four", 3), (None, "other words stand here", 4), ("a", "one two three four", 2)], schema)
    found = simhash.near_duplicates(docs, keep=["text"]).collect()
    assert sorted((r.doc_id or "", r.component_id or "") for r in found) == [("", ""), ("", "a"), ("a", "a"), ("a", "a"), ("b", "a")]
    assert simhash.linked(pa.table({"_slot": pa.array([], pa.int64()), "_fp": pa.array([], pa.int64())})).num_rows == 0
