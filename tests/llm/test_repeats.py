"""Repeated passages and near copies where hashes, skew and state are put to the test."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dqengine.llm import minhash, substring_index, suffix_dedup
from dqengine.llm import windows as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def words_left(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    counts = collections.Counter(tuple(w[j : j + window]) for w in words for j in range(len(w) - window + 1))
    left = []
    for w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if counts[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        left.append(" ".join(x for x, g in zip(w, gone) if not g))
    return left


def bytes_left(texts, window):
    seen, left = set(), []
    for t in texts:
        raw, own = t.encode(), set()
        gone = bytearray(len(raw))
        for j in range(len(raw) - window + 1):
            own.add(raw[j : j + window])
            if raw[j : j + window] in seen:
                gone[j : j + window] = b"\1" * window
        seen |= own
        left.append(bytes(c for c, g in zip(raw, gone) if not g))
    return left


def labels_of(texts, shingle, percent=80):
    sets = []
    for t in texts:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[j : j + shingle]) for j in range(max(1, len(w) - shingle + 1))} if w else set())
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def shared(texts):
    """Passages that most texts hold in surroundings of their own, with edits here and there."""
    rng = np.random.default_rng(11)
    passage = [f"shared{i}" for i in range(60)]
    for i in range(texts):
        own = [f"own{i}x{j}" for j in range(20)]
        middle = list(passage[: int(rng.integers(25, 61))])
        if i % 3 == 0:
            middle[int(rng.integers(len(middle)))] = f"edit{i % 6}"
        yield " ".join([*own, *middle, *own[::-1]])


def test_words_that_collide_under_every_odd_base_are_different(spark):
    tail = " ".join(f"w{i}" for i in range(34))
    texts = []
    for n in (1024, 4096):
        one, two = thue_morse(n), thue_morse(n, True)
        texts += [f"{one} {tail}", f"{two} {tail}", one, two, one + " x"]
    got = {r.doc_id: r.kept for r in substring_index.dedup(table(spark, texts), batches=1).collect()}
    assert got == dict(enumerate(texts))
    label, size = labels_of(texts, 4), [max(1, len(t.split()) - 3) for t in texts]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, texts), shingle=4).collect()}
    assert found == {i: (size[i], label[i]) for i in range(len(texts))} and label[2:5] == [2, 3, 4]


def test_equal_hashes_of_different_words_stop_the_job():
    units = W.Spec(True, 35, 14, False).units(np.frombuffer(b" a b\tc ", np.uint8), np.array([0, 7]))
    assert W.proven(units, [{"start": -2, "end": 2, "proof": b"a b"}, {"start": 2, "end": 3, "proof": None}]).all()
    with pytest.raises(RuntimeError, match="another seed"):
        W.proven(units, [{"start": 1, "end": 9, "proof": b"b d"}])


@pytest.mark.parametrize("window", [20, 50, 138, 200])
def test_windows_of_any_width(spark, window):
    rng = np.random.default_rng(2)
    part = "".join(rng.choice(list("abcdefgh"), 480))
    texts = ["head " + part + " tail", part[:300] + "?" + part[300:], "x" + part[100:] + "y" + part[:190], "ab" * 300, "ab" * 150 + "c" + "ab" * 200]
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(table(spark, texts), window=window).collect()}
    assert [got[i] for i in range(len(texts))] == bytes_left(texts, window)


def left_by(spans, texts, spec):
    """What is left of texts without the units that spans cover."""
    found = {r._span_key: [s.asDict() for s in r._spans] for r in spans.collect()}
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        units = spec.units(raw, np.array([0, len(raw)]))
        keep = np.flatnonzero(~W.proven(units, found.get(i))).tolist()
        yield b" ".join(units.cut(j, j + 1) for j in keep) if spec.words else raw[keep].tobytes()


@pytest.mark.parametrize("wide", [2, 4096])
def test_keys_with_many_contexts(spark, tmp_path, wide):
    """With a low limit keys of several contexts go by windows, with the usual one none does: same removals."""
    texts = list(shared(60))
    docs = table(spark, texts).select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"))
    spec = W.Spec(False, 50, 20, True, wide=wide)
    rows = W.anchor_rows(docs, spec, 1)
    assert rows.where("hit_doc is not null").count() > 0
    found = suffix_dedup.first_hits(pa.Table.from_batches(rows.toArrow().to_batches()), spec)
    assert any(len(x) for x in found["wide"].to_pylist()) == (wide == 2)
    assert list(left_by(suffix_dedup.repeats(docs, spec), texts, spec)) == bytes_left(texts, 50)
    spec = W.Spec(True, 35, 14, False, wide=wide)
    index = substring_index.FingerprintIndex(spark, str(tmp_path / "index"), spec, 4)
    spans = index.repeats(docs, [index.add(docs.where("_key % 2 = 0")), index.add(docs.where("_key % 2 = 1"))])
    assert list(left_by(spans, texts, spec)) == [t.encode() for t in words_left(texts)]


def test_windows_of_wide_keys(spark):
    """The way of keys with many contexts alone, over all anchors."""
    texts = list(shared(40))
    docs = table(spark, texts).select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"))
    for spec, left in ((W.Spec(False, 50, 20, True), bytes_left(texts, 50)), (W.Spec(True, 35, 14, False), [t.encode() for t in words_left(texts)])):
        rows = []
        for i, t in enumerate(texts):
            units = spec.units(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
            pos = W.anchors(units.values, units.at, spec)[3].astype(np.int32)
            rows.append((i, b"", b"", b"", pos.tobytes()))
        hits = W.wide_hits(docs, spark.createDataFrame(rows, W.HITS), spec)
        assert list(left_by(W.spans_by_doc(W.proofs(docs, hits, spec)), texts, spec)) == left


def test_index_by_batches_and_after_opening(spark, tmp_path):
    texts = [*shared(30), "short", "", None, " ".join(f"own0x{j}" for j in range(20)) + " end", *list(shared(4))[::-1]]
    docs = table(spark, texts).select(F.col("doc_id").alias("_key"), F.col("text").alias("_text")).cache()
    want = dict(enumerate(words_left(texts)))
    for n, reopen in ((1, False), (3, True), (10, False)):
        path = str(tmp_path / f"index{n}")
        index = substring_index.FingerprintIndex.create(spark, path)
        hits = []
        for i in range(n):
            hits.append(index.add(docs.where(F.pmod(F.col("_key"), F.lit(n)) == i)))
            if reopen:
                index = substring_index.FingerprintIndex.open(spark, path)
        assert sum(map(len, index.levels)) == bin(n).count("1") and index.state == n
        spans = index.repeats(docs, hits)
        base = docs.withColumn("_id", F.col("_key"))
        got = substring_index.remaining(base, spans, docs.withColumnRenamed("_key", "doc_id"), "doc_id", "_text", [])
        assert {r.doc_id: r.kept for r in got.collect()} == want


def test_merging_runs():
    rng = np.random.default_rng(4)

    def run(n):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 9, (n, 2))})
        made = [np.array([p[i] for p in pairs], np.uint64) for i in (0, 1)]
        return *made, rng.integers(1, 3, len(pairs)), rng.integers(0, 50, len(pairs)), rng.integers(0, 5, len(pairs)).astype(np.int32)

    for _ in range(60):
        runs = [run(int(rng.integers(0, 30))) for _ in range(int(rng.integers(1, 5)))]
        want = {}
        for r in runs:
            for k, c, n, d, p in zip(*(x.tolist() for x in r)):
                old = want.get((k, c))
                want[k, c] = (n, d, p) if old is None else (min(2, old[0] + n), *min((d, p), old[1:]))
        got = substring_index.merged(runs)
        assert [tuple(x) for x in zip(*(x.tolist() for x in got))] == [(k, c, *v) for (k, c), v in sorted(want.items())]


def test_batches_of_files(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    texts = list(shared(24))
    table(spark, texts).repartition(5).write.parquet(path)
    parts = substring_index.by_files(spark, path, 3)
    assert len(parts) == 3 and sum(p.count() for p in parts) == 24
    got = {r.doc_id: r.kept for r in substring_index.dedup(spark.read.parquet(path), batches=parts).collect()}
    assert [got[i] for i in range(24)] == words_left(texts)
    assert substring_index.by_files(spark, path, 9) is None


def chains(rng):
    """Groups of near copies of several templates, some linked through chains only."""
    rows = []
    for t in range(4):
        base = [f"t{t}w{i}" for i in range(100)]
        for i in range(40):
            w = list(base)
            at = (i * 3) % 90
            w[at : at + 3 + i % 6] = [f"e{t}x{i}y{j}" for j in range(3 + i % 6)]
            rows.append(" ".join(w))
    for i in range(30):  # each shares most of its words with the next one only
        rows.append(" ".join(f"c{j}" for j in range(i * 8, i * 8 + 100)))
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("lists, sets, close", [(1024, 512, 8), (10, 6, 30)])
def test_near_duplicates_by_stars(spark, monkeypatch, lists, sets, close):
    monkeypatch.setattr(minhash, "LIST_BLOCK", lists)
    monkeypatch.setattr(minhash, "SET_BLOCK", sets)
    monkeypatch.setattr(minhash, "CLOSE", close)
    texts = chains(np.random.default_rng(7))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, texts), shingle=4, matches=30).collect()}
    assert [got[i] for i in range(len(texts))] == labels_of(texts, 4)


def test_open_stars_are_compared_by_members():
    """Members of three labels, two of which one pair links, and sets of other sizes."""
    a = [f"a{i}" for i in range(100)]
    step = lambda w, i: [*w[:i], *(f"s{i}z{j}" for j in range(10)), *w[i + 10 :]]
    texts = [" ".join(x) for x in (a, step(a, 0), step(step(step(a, 0), 20), 40), step(step(a, 0), 20), a[:40], step(a[:40], 3))]
    label = [0, 0, 2, 2, 4, 5]
    columns = {"_key": list(range(6)), "_cluster": [9] * 6, "_i": [0] * 6, "_j": [1] * 6, "_label": label, "_words": pa.array([t.encode() for t in texts], pa.binary())}
    found = [(f["a"], f["b"]) for f in minhash.open_confirmed(pa.table(columns), 4, 75).to_pylist()]
    want = {(x, y) for x in range(6) for y in range(x + 1, 6) if label[x] != label[y] and labels_of([texts[x], texts[y]], 4, 75)[1] == 0}
    assert len(found) == 1 and {tuple(sorted(f)) for f in found} <= want


def test_words_of_texts():
    texts = [b"", b"  one\ttwo ", b"three", b"four", b"\x0b", "é\u00a0x \x1c".encode(), b"one"]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    words = W.Words.of(raw, at)
    want = [w for t in texts for w in t.split()]
    assert [words.cut(i, i + 1) for i in range(len(want))] == want and words.cut(0, len(want)) == b" ".join(want)
    assert words.begin.tolist() == np.r_[0, np.cumsum([len(t.split()) for t in texts])].tolist()
    ids, known = words.numbered()
    assert [known[int(i)] for i in ids] == want and len(known) == len(set(want))


def test_shingle_codes_are_those_of_words():
    rng = np.random.default_rng(5)
    for size in (1, 3, 5, 9):
        texts = [[int(x) for x in rng.integers(0, 40_000 if size == 9 else 6, rng.integers(0, 12))] for _ in range(50)]
        ids = np.array([w for t in texts for w in t], np.uint64)
        code, text, start = minhash.shingle_codes(ids, np.r_[0, np.cumsum([len(t) for t in texts])], size)
        want = [(i, tuple(t[j : j + size])) for i, t in enumerate(texts) for j in range(max(1, len(t) - size + 1) if t else 0)]
        assert [i for i, _ in want] == text.tolist()
        seen = {}
        for c, (_, s) in zip(code.tolist(), want):
            assert seen.setdefault(c, s) == s
        assert len(seen) == len({s for _, s in want})


def test_five_word_shingles_find_every_pair(spark):
    """Recall of the pipeline's parameters against all pairs: texts of similarity 0.8 and a little more."""
    rng = np.random.default_rng(13)
    texts = []
    for i in range(60):
        base = [f"r{i}w{j}" for j in range(150)]
        near = list(base)
        at = int(rng.integers(0, 120))
        near[at : at + 11] = [f"n{i}x{j}" for j in range(11)]
        texts += [" ".join(base), " ".join(near)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, texts)).collect()}
    want = labels_of(texts, 5)
    assert sum(a != i for i, a in enumerate(want)) == 60
    assert [got[i] for i in range(len(texts))] == want
