"""Structure repair against all edits tried in order of cost, in SQL, and with conversations over many ranges."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from dqengine.llm import structure_repair as R
from tests.compare import connect, difference

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def slow(rows):
    """cost, edits, turns of the cheapest and least repair: best first over (cost, letters)."""
    seen, faults = set(), []
    for role, text in rows:
        last = BLANK.findall(text)[-1:]
        faults.append("blank" if not last else "again" if (role, text) in seen else "cut" if last[0] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, out, faults
        key = (i, roles[-1:])
        if key in done:  # what comes later costs more or has greater letters
            continue
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        done.add(key)
        fill = "assistant" if roles[-1:] == "u" else "user"
        heapq.heappush(heap, (cost + 3, letters + "I", i, roles + fill[0], (*out, (fill, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, roles, out))
            if faults[i] not in ("blank", "again"):
                more = 3 * (faults[i] == "cut")
                heapq.heappush(heap, (cost + more, letters + "K", i + 1, roles + (role[:1] or "?"), (*out, (role, text))))
                heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, roles + fill[0], (*out, (fill, text))))


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def expected(rows):
    """Rows (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    cost, letters, out, faults = slow([r[1:] for r in rows])
    pairs = [(a[1][:1] or "?") + (b[1][:1] or "?") for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("again"), faults.count("cut"), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, digest(out)), out


def made(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "u", "", "assistant", "user"], ["Yes.", "No!", "so", " \t", "", "What?  ", "a\n", "end.", "more", "Ünd."]
    return [(int(t), roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]) for t in np.sort(rng.integers(0, 12, n))]


def ordered(rows):
    key = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key(r)))


def check(spark, conversations, gone=()):
    rows = [(c, *r, False) for c, turns in conversations.items() for r in turns] + [(c, 1, "user", "gone.", True) for c in gone]
    np.random.default_rng(1).shuffle(rows)
    rows = [(None if c is None else int(c), None if t is None else int(t), str(r), str(x), str(g) == "True", "x") for c, t, r, x, g in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean, _at string").repartition(3)
    found = {r.conv_id: tuple(r)[1:] for r in R.report(df, "gone").collect()}
    turns = {}
    for r in R.repair(df, "gone").collect():
        turns.setdefault(r.conv_id, []).append((r.place, r.edit, r.role, r.text))
    want = {c: expected(ordered(t)) for c, t in conversations.items()}
    assert found == {c: w[0] for c, w in want.items()} | {c: (0, 0, 0, 0, 0, 0, "", digest([])) for c in gone if c not in want}
    for c, (figures, out) in want.items():
        mine = sorted(turns.get(c, []))
        assert [t[2:] for t in mine] == list(out) and [t[0] for t in mine] == list(range(len(out)))
        assert "".join(t[1] for t in mine) == figures[6].replace("D", "")


def test_cheapest_and_least_edits(spark):
    rng = np.random.default_rng(3)
    some = {int(c): made(rng, int(rng.integers(1, 9))) for c in range(60)}
    some[None] = [(None, "user", "Hello."), (3, "assistant", "Yes.")]
    some[100] = [(1, "user", "Same."), (1, "user", "Same."), (1, "user", "Same."), (9, "system", "Last.")]
    some[101] = [(None, "tool", ""), (None, "tool", "x")]
    check(spark, some, gone=[7, 500])


@pytest.mark.parametrize("limit", [1, 400])
def test_conversations_over_many_ranges_and_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "LIMIT", limit)
    monkeypatch.setattr(R, "BLOCK_BITS", 2)
    rng = np.random.default_rng(4)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        check(spark, {int(c): made(rng, int(rng.integers(1, 14))) for c in range(12)} | {50: made(rng, 16)}, gone=[3, 77])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_a_long_conversation_takes_time_in_proportion():
    rng = np.random.default_rng(6)
    codes = bytes(rng.integers(0, 16, 300_000).tolist())
    letters = R.edits(codes)
    assert len(letters) == len(codes) + 1 and R.cost(codes, letters) > 300_000
    short = R.edits(codes[:12])
    assert R.cost(codes[:12], short) >= 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B? C") for c in range(6) for t in range(6)] + [(None, None, None, None)]
    found = R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if what == 4 else role, "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text, what == 0)
        want += [row] * (2 if what == 3 else 1)
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, want))


def test_query_is_its_sql(spark):
    con = connect("/root/testdata/sf0.01")
    assert difference(R.query(spark, "/root/testdata/sf0.01"), con, R.SQL) is None


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.report(empty).collect() == [] and R.repair(empty).collect() == [] and R.report(R.damaged(empty), "gone").collect() == []
