"""Repair of the structure of conversations: the cheapest edits after which roles read ``(s?(ua)+)?``.

Edits of a conversation are paths in a graph of layers: a node is a number of turns read and what the roles read so far allow next; Keep,
Rerole and Delete lead to the next layer, Insert stays in its own. Least costs from the start and to the end tell which arcs are
tight, that is, on a path of least cost; there are no others in the graph that is left. A walk along tight arcs keeps the set of all
nodes that the letters so far lead to, and takes the least letter that leaves it. Cost vectors matter only by their differences, so
each step is one of a few and remembered.

Turns are dealt out by ranges of (conversation, turn). What begins and ends inside a range and fits in ``LIMIT`` bytes is repaired where it
stands. First and last conversations of a range and larger ones go on as rows: what is read twice is found by grouping digests, a
conversation then needs one byte a turn in one place, no more than the edits that are its result, and its text is only streamed
past a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqengine.llm.common import free_memory, materialize, partitions, struct_of
from dqengine.llm.turns import TURN_DIGEST_SQL, in_order, turn_digest

BLANKS = " \t\n\x0b\x0c\r"
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
"""What edits cost; the last is added to a truncated turn that stays."""
LIMIT = 32 << 20
"""Characters of a conversation that is repaired at once; larger ones are not held in memory."""
BLOCK_BITS = 13
"""A block of a conversation is what it has of 2**BLOCK_BITS rows of a range."""

# A turn's code is the place of its role's initial in INITIALS, or 3, and four times its fault.
INITIALS = "sua"
GOOD, BLANK, DUPLICATE, CUT = range(4)
# States: nothing yet, a system turn, a user turn, an assistant turn. Only the first and the last may end.
AFTER = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
PUT = (2, 2, 3, 2)
"""The state after a turn that is inserted or reroled: the role is free, but has to fit."""
FINAL = (0, 3)
FAR = 1 << 40
ROLE = {2: "user", 3: "assistant"}


def initial(role: str) -> int:
    return INITIALS.find(role[:1]) % 4 if role else 3


def fault(text: str, seen: bool) -> int:
    last = text.rstrip(BLANKS)[-1:]
    return BLANK if not last else DUPLICATE if seen else GOOD if last in ".!?" else CUT


@lru_cache(None)
def row_arcs(code: int) -> tuple:
    """(letter, from, to, cost) of what can be done with a turn."""
    kind, bad = code % 4, code // 4
    arcs = [("D", q, q, DELETE) for q in range(4)]
    if bad not in (BLANK, DUPLICATE):
        more = TRUNCATED if bad == CUT else 0
        arcs += [("K", q, AFTER[q][kind], more) for q in range(4) if AFTER[q][kind] is not None]
        arcs += [("R", q, PUT[q], REROLE + more) for q in range(4)]
    return tuple(arcs)


def _least(costs: list[int]) -> tuple:
    low = min(costs)
    return tuple(min(c - low, FAR) for c in costs)


def _inserted(f: list[int]) -> tuple:
    """Least costs from the start, inserts counted."""
    f[2] = min(f[2], INSERT + min(f[0], f[1], f[3]))
    f[3] = min(f[3], INSERT + f[2])
    return _least(f)


def _inserting(b: list[int]) -> tuple:
    """Least costs to the end, inserts counted."""
    b[2] = min(b[2], INSERT + b[3])
    return _least([min(x, INSERT + b[2]) if q != 2 else x for q, x in enumerate(b)])


START = _inserted([0, FAR, FAR, FAR])
END = _inserting([0 if q in FINAL else FAR for q in range(4)])


@lru_cache(None)
def forward(f: tuple, code: int) -> tuple:
    found = [2 * FAR] * 4
    for _, q, to, cost in row_arcs(code):
        found[to] = min(found[to], f[q] + cost)
    return _inserted(found)


@lru_cache(None)
def backward(b: tuple, code: int) -> tuple:
    found = [2 * FAR] * 4
    for _, q, to, cost in row_arcs(code):
        found[q] = min(found[q], cost + b[to])
    return _inserting(found)


@lru_cache(None)
def walk(f: tuple, code: int | None, b: tuple, after: tuple, at: frozenset) -> tuple[str, frozenset]:
    """The letters that are taken in a layer and for its turn (none: the end) from a set of nodes, and the nodes they lead to."""
    here = min(x + y for x, y in zip(f, b))
    rows = [] if code is None else row_arcs(code)
    best = min((f[q] + cost + after[to] for _, q, to, cost in rows), default=0)
    tight = [arc for arc in rows if f[arc[1]] + arc[3] + after[arc[2]] == best]
    letters = ""
    while True:
        found = [(letter, to) for letter, q, to, _ in tight if q in at]
        if code is None and any(q in FINAL and f[q] + b[q] == here for q in at):
            return letters, at
        found += [("I", PUT[q]) for q in at if f[q] + INSERT + b[PUT[q]] == here]
        least = min(letter for letter, _ in found)
        at = frozenset(to for letter, to in found if letter == least)
        letters += least
        if least != "I":
            return letters, at


def edits(codes: bytes) -> list[str]:
    """Letters for every turn, what is inserted before it included, and for the end."""
    behind = [END]
    for code in reversed(codes):
        behind.append(backward(behind[-1], code))
    f, at, letters = START, frozenset([0]), []
    for i, code in enumerate(codes):
        b = behind.pop()
        more, at = walk(f, code, b, behind[-1], at)
        letters.append(more)
        f = forward(f, code)
    letters.append(walk(f, None, END, END, at)[0])
    return letters


def cost(codes: bytes, letters: list[str]) -> int:
    total = 0
    for code, done in zip([*codes, 0], letters):
        total += INSERT * done.count("I") + REROLE * done.count("R") + DELETE * done.count("D")
        total += TRUNCATED if code // 4 == CUT and done[-1:] in ("K", "R") else 0
    return total


class Writer:
    """Takes turns with their letters in order and gives the turns after repair."""

    def __init__(self):
        self.state = 0

    def turns(self, letters: str, role: str = "", text: str = "") -> Iterator[tuple[str, str, str]]:
        for letter in letters:
            if letter == "K":
                self.state = AFTER[self.state][initial(role)]
                yield letter, role, text
            elif letter != "D":
                self.state = PUT[self.state]
                yield letter, ROLE[self.state], text if letter == "R" else ""


class Digest:
    """SHA-256 of ``role:text`` of turns, with newlines between."""

    def __init__(self):
        self.hash, self.between = hashlib.sha256(), ""

    def add(self, turns) -> None:
        for _, role, text in turns:
            self.hash.update(f"{self.between}{role}:{text}".encode())
            self.between = "\n"


class Held:
    """The turns of one conversation as they come."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.size = conv_id, [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[2]) + len(row[3]) + 64

    def coded(self) -> tuple[list[tuple], bytes]:
        seen, rows, codes = set(), [r for r in self.rows if not r[4]], bytearray()
        for _, _, role, text, _ in rows:
            codes.append(initial(role) + 4 * fault(text, (role, text) in seen))
            seen.add((role, text))
        return rows, bytes(codes)


LEGAL = {(0, 1), (1, 2), (2, 1)}


def counts(codes: bytes) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns and neighbours whose initials don't fit."""
    faults = [c // 4 for c in codes]
    illegal = sum((a % 4, b % 4) not in LEGAL for a, b in zip(codes, codes[1:]))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, edit string, role string, text string"
ARROW = {"long": pa.int64(), "integer": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
RAW = "_at long, turn long, _role string, _text string, _gone boolean, _code integer, _raw boolean"


def summary(held: Held) -> tuple:
    rows, codes = held.coded()
    letters = edits(codes)
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    writer, digest = Writer(), Digest()
    for row, done in zip([*rows, (0, 0, "", "")], letters):
        digest.add(writer.turns(done, row[2], row[3]))
    return (gaps, *counts(codes), cost(codes, letters), "".join(letters), digest.hash.hexdigest())


def repaired(held: Held) -> Iterator[tuple]:
    rows, codes = held.coded()
    writer, place = Writer(), 0
    for row, done in zip([*rows, (0, 0, "", "")], edits(codes)):
        for turn in writer.turns(done, row[2], row[3]):
            yield (place, *turn)
            place += 1


def _of_conversations(rows: DataFrame, fields: str):
    schema = rows.select("conv_id").schema
    for f in struct_of(fields):
        schema.add(f)
    return schema


def _streamed(ordered: DataFrame, fields: str, solve) -> DataFrame:
    """``solve`` of every conversation that stands inside a range; the turns of all others as they are (_raw)."""
    more = struct_of(fields)
    schema = _of_conversations(ordered, f"{fields}, {RAW}")
    types = [ARROW[f.dataType.typeName()] for f in schema.fields[1:]]
    limit, n = LIMIT, len(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, weight, kind = [], 0, None

        def flush():
            columns = list(zip(*out)) if out else [[]] * (len(types) + 1)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], types))], schema.names)

        def raw(held: Held):
            for at, turn, role, text, gone in held.rows:
                out.append((held.conv_id, *[None] * n, at, turn, role, text, gone, initial(role) + 4 * fault(text, False), True))

        def done(held: Held):
            found = solve(held)
            for row in [found] if isinstance(found, tuple) else found:
                out.append((held.conv_id, *row, *[None] * 6, False))

        held, whole = None, False
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "_at", "turn", "role", "text", "_gone"))):
                if held is None or conv_id != held.conv_id:
                    if held is not None:
                        (done if whole else raw)(held)
                        weight += held.size
                    whole, held = held is not None, Held(conv_id)
                held.add(tuple(row))
                if held.size > limit:
                    raw(held)
                    weight += held.size
                    held, whole = Held(conv_id), False
                if weight > 1 << 22 or len(out) > 20_000:
                    yield flush()
                    out, weight = [], 0
        if held is not None:
            raw(held)
            yield flush()
        free_memory()

    return ordered.select("conv_id", "_at", "turn", "role", "text", "_gone").mapInArrow(run, schema)


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _coded(rows: DataFrame) -> DataFrame:
    """Turns of raw conversations with their final codes: repeated ones are those after the first of their digest."""
    rows = rows.where("not _gone").select("conv_id", "_at", F.shiftright("_at", BLOCK_BITS).alias("_block"), "_code", turn_digest(F.col("_role"), F.col("_text")).alias("_digest"))
    first = rows.groupBy(F.col("conv_id").alias("_c"), F.col("_digest").alias("_d")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    met = rows.join(first, _same("conv_id", "_c") & (F.col("_digest") == F.col("_d")), "left")
    again = (F.col("_at") > F.col("_first")) & (F.shiftright("_code", 2) != BLANK)
    return met.select("conv_id", "_block", "_at", F.when(again, F.col("_code") % 4 + 4 * DUPLICATE).otherwise(F.col("_code")).alias("_code"))


PLAN = "_block long, _letters string, blank long, duplicate long, truncated long, illegal long, cost long"


def _planned(rows: DataFrame) -> DataFrame:
    """Per block of a raw conversation its letters, one field a turn, with the conversation's figures in its first block."""
    turns = F.array_sort(F.collect_list(F.struct("_at", "_code")))
    blocks = _coded(rows).groupBy("conv_id", "_block").agg(F.transform(turns, lambda t: t["_code"].cast("byte")).alias("_codes"))
    schema = _of_conversations(rows, PLAN)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_block")
        each = [np.asarray(x.values.to_numpy(), np.uint8).tobytes() for x in group["_codes"]]
        codes = b"".join(each)
        letters = edits(codes)
        figures = (*counts(codes), cost(codes, letters))
        out, at = [], 0
        for i, part in enumerate(each):
            last = i == len(each) - 1
            out.append(",".join(letters[at : at + len(part) + last]))
            at += len(part)
        none = [None] * (len(each) - 1)
        columns = [group["conv_id"].combine_chunks(), group["_block"].combine_chunks(), pa.array(out, pa.string()), *(pa.array([x, *none], pa.int64()) for x in figures)]
        return pa.Table.from_arrays(columns, schema.names)

    return blocks.groupBy("conv_id").applyInArrow(run, schema)


def _written(rows: DataFrame, planned: DataFrame, fields: str, start, take, end) -> DataFrame:
    """Streams the turns of each raw conversation behind the letters of their block. ``take`` gets what ``start`` made, letters, role
    and text and gives rows, as does ``end``."""
    turns = rows.where("not _gone").select("conv_id", F.shiftright("_at", BLOCK_BITS).alias("_block"), "_at", F.col("_role").alias("role"), F.col("_text").alias("text"))
    plans = planned.select("conv_id", "_block", F.lit(-1).cast("long").alias("_at"), F.lit(None).cast("string").alias("role"), F.col("_letters").alias("text"))
    stream = turns.unionByName(plans).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "_block", "_at")
    schema = _of_conversations(rows, fields)
    types = [ARROW[f.dataType.typeName()] for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, letters, out, kind = None, None, iter(()), [], None

        def flush():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], types))], schema.names)

        def close():
            for rest in letters:
                out.extend((conv, *x) for x in take(state, rest, "", ""))
            out.extend((conv, *x) for x in end(state))

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, at, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "_at", "role", "text"))):
                if state is None or c != conv:
                    if state is not None:
                        close()
                    conv, state = c, start()
                if at < 0:
                    letters = iter(text.split(","))
                else:
                    out.extend((conv, *x) for x in take(state, next(letters), role, text))
            if out:
                yield flush()
                out = []
        if state is not None:
            close()
            if out:
                yield flush()
        free_memory()

    return stream.mapInArrow(run, schema)


def _rows(turns: DataFrame, gone: str | None) -> DataFrame:
    """Turns without nulls in role and text, with digests."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    flag = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), flag.alias("_gone"))
    return rows.withColumn("_digest", turn_digest(F.col("role"), F.col("text")))


def report(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the letters of the edits) and
    repaired_sha256.

    ``turns`` has conv_id, turn, role and text; where the column ``gone`` is true, a row only names its conversation. A null role
    or text is one space; a null turn comes first and makes no gap; turns of one number stand in order of their digest, equal rows
    repeat each other. A null conv_id is a conversation of its own. Empty texts are blank; long texts count whole. An empty table
    gives no rows. Other columns are left alone, whatever they are called.
    """
    found = materialize(_streamed(in_order(_rows(turns, gone)), RESULT, summary), "repair-ranges")
    names = [f.name for f in struct_of(RESULT)]
    raw = found.where("_raw").select("conv_id", *[f.name for f in struct_of(RAW)])
    planned = materialize(_planned(raw), "repair-plans")
    of_conv = raw.groupBy("conv_id").agg(
        (F.max(F.when(~F.col("_gone"), F.col("turn"))) - F.min(F.when(~F.col("_gone"), F.col("turn"))) + 1).alias("_span"),
        F.count_distinct(F.when(~F.col("_gone"), F.col("turn"))).alias("_turns"),
    )
    figures = planned.where("cost is not null").select(F.col("conv_id").alias("_fc"), "blank", "duplicate", "truncated", "illegal", "cost")
    pieces = F.array_sort(F.collect_list(F.struct("_block", F.translate("_letters", ",", "").alias("_l"))))
    audits = planned.groupBy(F.col("conv_id").alias("_ac")).agg(F.array_join(F.transform(pieces, lambda p: p["_l"]), "").alias("audit"))

    def digested(state, letters, role, text):
        state[1].add(state[0].turns(letters, role, text))
        return ()

    hashes = _written(raw, planned, "repaired_sha256 string", lambda: (Writer(), Digest()), digested, lambda state: [(state[1].hash.hexdigest(),)]).withColumnRenamed("conv_id", "_hc")
    joined = of_conv.join(figures, _same("conv_id", "_fc"), "left").join(audits, _same("conv_id", "_ac"), "left").join(hashes, _same("conv_id", "_hc"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    others = joined.select(
        "conv_id", F.coalesce(F.col("_span") - F.col("_turns"), F.lit(0)).alias("gaps"), *[zero(c) for c in names[1:6]], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )
    return found.where("not _raw").select("conv_id", *names).unionByName(others)


def repair(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """The turns after repair: conv_id, place (from 0), edit (Keep, Rerole or Insert), role and text. Odd rows as in ``report``; a
    conversation of which nothing is left has no rows."""
    found = materialize(_streamed(in_order(_rows(turns, gone)), TURNS, repaired), "repair-turn-ranges")
    names = [f.name for f in struct_of(TURNS)]
    raw = found.where("_raw").select("conv_id", *[f.name for f in struct_of(RAW)])
    planned = materialize(_planned(raw), "repair-turn-plans")

    def placed(state, letters, role, text):
        for turn in state[0].turns(letters, role, text):
            yield (state[1], *turn)
            state[1] += 1

    others = _written(raw, planned, TURNS, lambda: [Writer(), 0], placed, lambda _: ())
    return found.where("not _raw").select("conv_id", *names).unionByName(others)


def damaged(turns: DataFrame) -> DataFrame:
    """The turns of the test of repair: by CRC-32 of conv_id and turn some are dropped (gone), emptied, robbed of their stops, repeated
    or given to the user. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("_what")
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), what)
    text = F.when(F.col("_what") == 1, "").when(F.col("_what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_what") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_what") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: damage and repair of every conversation."""
    return report(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone="gone")


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB: eight steps a byte over a list."""
    entries = f"flatten(list_transform(range(0, length({text})), lambda i: list_transform(range(0, 8), lambda j: CASE WHEN j = 0 THEN ascii(({text})[i + 1])::BIGINT ELSE 0 END)))"
    step = "lambda c, x: CASE WHEN xor(c, x) % 2 = 1 THEN xor(xor(c, x) // 2, 3988292384) ELSE xor(c, x) // 2 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {entries}), {step}), 4294967295)"


SQL = f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id
  FROM conversations),
drawn AS (SELECT *, {crc32_sql("id")} % 20 AS what FROM source),
rows_left AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN what = 1 THEN '' WHEN what = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, unnest(range(0, CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {TURN_DIGEST_SQL}) AS i, role[1] AS kind FROM rows_left),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS is_cut, lag(kind) OVER (PARTITION BY conv_id ORDER BY i) || kind AS pair FROM placed),
judged AS (
  SELECT *, is_blank OR is_again AS goes, CASE WHEN is_cut THEN 3 ELSE 0 END AS more FROM marked),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
    count(*) FILTER (is_again AND NOT is_blank) AS duplicate, count(*) FILTER (is_cut AND NOT goes) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
-- States: 0 nothing yet, 1 system, 2 user, 3 assistant.
put(q, nxt, letters, price, said) AS (
  VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 3, ['user:']), (1, 2, 'I', 3, ['user:']),
    (3, 2, 'I', 3, ['user:']), (2, 3, 'I', 3, ['assistant:']), (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 3, 'II', 6, ['user:', 'assistant:'])),
moves(q, kind, nxt) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
layers AS (
  SELECT conv_id, 0::BIGINT AS i, put.nxt AS q, put.price AS cost, put.letters AS audit, put.said AS said FROM figures, put WHERE put.q = 0
  UNION ALL
  SELECT conv_id, i, q, cost, audit, said FROM (
    SELECT s.conv_id, s.i, put.nxt AS q, s.cost + put.price AS cost, s.audit || put.letters AS audit, s.said || put.said AS said
    FROM (
      SELECT l.conv_id, j.i, l.q, l.cost + 4 AS cost, l.audit || 'D' AS audit, l.said FROM layers l JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i + 1
      UNION ALL
      SELECT l.conv_id, j.i, m.nxt, l.cost + j.more, l.audit || 'K', l.said || [j.role || ':' || j.text]
      FROM layers l JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i + 1 AND NOT j.goes JOIN moves m ON m.q = l.q AND m.kind = j.kind
      UNION ALL
      SELECT l.conv_id, j.i, CASE l.q WHEN 2 THEN 3 ELSE 2 END, l.cost + 3 + j.more, l.audit || 'R', l.said || [CASE l.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || j.text]
      FROM layers l JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i + 1 AND NOT j.goes) s JOIN put USING (q))
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY cost, audit) = 1),
best AS (
  SELECT l.conv_id, cost, audit, said FROM layers l JOIN figures f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.i WHERE q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY l.conv_id ORDER BY cost, audit) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
