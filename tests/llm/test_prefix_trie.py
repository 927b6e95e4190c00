"""The prefix trie against one built turn by turn, in SQL, and with conversations and lists over many ranges."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from dqengine.llm import prefix_trie as P
from tests.compare import connect, difference


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()


def slow(rows, rebuilt=True):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    plain = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(plain.get(base, [])[:h] + own[h:])
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below = [sums[k] for k in children[node]]
        sums[node] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    return collections.Counter(
        (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), *sums[n], hashlib.sha256(",".join(str(c) for c in members[n] if paths[c] == n).encode()).hexdigest())
        for n in members
    )


SCHEMA = "conv_id long, turn long, role string, text string, hash string, least int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def check(spark, rows, parts=3, **how):
    order = np.random.default_rng(0).permutation(len(rows))
    df = spark.createDataFrame([(*rows[i], "x", 1) for i in order], SCHEMA).repartition(parts)
    assert collections.Counter(map(tuple, P.trie(df, **how).select(COLUMNS).collect())) == slow(rows, **how)


def conversations(rng, n, turns=7, words=3):
    texts = ["", "Hi.", "Yes é", "No\n", "and 日本"][:words + 1]
    return [(int(c), int(t), ["user", "assistant", None][rng.integers(3)], texts[rng.integers(len(texts))]) for c in rng.choice(900, n, replace=False) - 300 for t in range(rng.integers(1, turns))]


def test_trie_of_rebuilt_conversations(spark):
    rng = np.random.default_rng(7)
    rows = conversations(rng, 150) + [(None, 1, "user", "lost"), (5, None, "user", "first"), (5, 2, None, None), (5, 2, "a", "b:c"), (5, 2, "a:b", "c"), (5, 2, "a", "b:c")]
    check(spark, rows)
    check(spark, rows, rebuilt=False)


@pytest.mark.parametrize("limit", [2, 1000])
def test_long_conversations_and_lists_over_many_ranges(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "NODES", limit)
    monkeypatch.setattr(P, "PIECE", limit)
    monkeypatch.setattr(P, "FAN", 2)
    long = [(c, t, "user", f"turn {t if t < 90 or c == 1 else t * c}") for c in (1, 2, 100, 101) for t in range(120)]
    copies = [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(3)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        check(spark, long + copies)
        check(spark, long + copies, rebuilt=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_query_is_its_sql(spark):
    assert difference(P.query(spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), P.SQL) is None


def test_empty_table_and_one_turn(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert P.trie(empty).collect() == []
    check(spark, [(7, 0, "user", "Only.")])
