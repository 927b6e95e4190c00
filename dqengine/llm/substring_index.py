"""Substring dedup with a log-structured fingerprint index.

Documents arrive in batches. A batch's window fingerprints (anchors, see ``windows``: key, context) become one sorted immutable
run: for each part of the key space the distinct (key, context) pairs in order, how often each occurred (two stands for more),
and where first. Before it is written, the batch is merge-joined part by part with the runs of history, so a window that
history has is found in the new document, and one that history had only once is found in the old document too. Runs of one
level are compacted into one of the next by merging two sorted runs at a time. What the fingerprints call equal is compared with
the words of the document it equals before anything is removed; different contexts of one key are compared word by word.

The index lives in a folder: runs as Parquet and a manifest for each state, the newest of which counts; so it can be opened again and
go on with the next batch, and a batch that failed half-way leaves the last state as it was. Runs that compaction has replaced stay in
the folder for those who read an older state.

A window is repeated if its word sequence also starts anywhere else, in the same document or another. A null text has no
words. Repeated, null or other than whole-number ids are documents of their own; a text with fewer words than the window loses
nothing; equal rows repeat each other and both lose their windows. Very long texts are read whole, one at a time; an empty table
gives no rows; columns to keep travel under names of their own, so theirs can't clash.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm import windows as W
from dqengine.llm.common import freed, materialize, shared_dir, struct_of, table, text_slices, utf8

WINDOW = 35
GRAM = 14
BATCHES = 3
FANOUT = 2
"""Runs of a level that are compacted into one of the next."""

RUN = struct_of("part int, key binary, context binary, count binary, doc binary, pos binary")
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _run_rows(part: int, run: Run) -> pa.Table:
    key, context, count, doc, pos = run
    packed = (key.tobytes(), context.tobytes(), W.planes(count), W.planes(doc), W.planes(pos.astype(np.int32)))
    return pa.table({"part": pa.array([part], pa.int32()), **{n: pa.array([v], pa.binary()) for n, v in zip(RUN.names[1:], packed)}})


def lower_bound(key: np.ndarray, context: np.ndarray, into_key: np.ndarray, into_context: np.ndarray) -> np.ndarray:
    """How many pairs of a sorted run lie below each (key, context): a search by key, then one by context inside equal keys."""
    low, high = np.searchsorted(into_key, key, side="left"), np.searchsorted(into_key, key, side="right")
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) >> 1
        below = into_context[mid] < context[open_]
        low[open_] = np.where(below, mid + 1, low[open_])
        high[open_] = np.where(below, high[open_], mid)
    return low


def merge_two(a: Run, b: Run) -> Run:
    """One sorted run from two: every pair goes to its own place plus its rank in the other run; equal pairs add their counts
    and keep the first place."""
    if not len(a[0]) or not len(b[0]):
        return b if not len(a[0]) else a
    rank = lower_bound(a[0], a[1], b[0], b[1])
    near = np.minimum(rank, len(b[0]) - 1)
    both = (b[0][near] == a[0]) & (b[1][near] == a[1])
    mine, theirs = np.flatnonzero(both), near[both]
    key, context, count, doc, pos = (x.copy() for x in a)
    count[mine] = np.minimum(count[mine] + b[2][theirs], 2)
    later = (b[3][theirs] < doc[mine]) | ((b[3][theirs] == doc[mine]) & (b[4][theirs] < pos[mine]))
    doc[mine[later]], pos[mine[later]] = b[3][theirs[later]], b[4][theirs[later]]
    only = np.ones(len(b[0]), bool)
    only[theirs] = False
    rest = np.flatnonzero(only)
    dropped = np.r_[0, np.cumsum(~only)]
    place = np.arange(len(key)) + rank - dropped[rank]
    other = np.ones(len(key) + len(rest), bool)
    other[place] = False
    out = []
    for x, y in zip((key, context, count, doc, pos), b):
        made = np.empty(len(other), x.dtype)
        made[place], made[other] = x, y[rest]
        out.append(made)
    return tuple(out)


def runs_in(rows: pa.Table) -> list[Run]:
    """The runs of a part, each row one sorted run."""
    return [W.unpack(rows.slice(i, 1)) for i in range(rows.num_rows)]


def merged(runs: list[Run]) -> Run:
    """Compaction: two runs at a time, the shortest first."""
    while len(runs) > 1:
        runs = sorted(runs, key=lambda r: len(r[0]))
        runs = [*runs[2:], merge_two(runs[0], runs[1])]
    return runs[0]


def compact(rows: pa.Table) -> pa.Table:
    return _run_rows(rows["part"][0].as_py(), merged(runs_in(rows)))


BOTH = struct_of("kind int, part int, key binary, context binary, count binary, doc binary, pos binary, hit_doc long, spans binary, mates binary, needs binary, wide binary")


def join_batch(new: pa.Table, history: pa.Table, spec: W.Spec) -> pa.Table:
    """The batch's own run (kind 0) and the hits (kind 1) that it brings for its documents and for those of history."""
    if not new.num_rows:
        return _both(pa.table({"part": pa.array([], pa.int32())}), 0)
    part = new["part"][0].as_py()
    key, context, count, doc, pos = W.unpack(new)
    order = np.lexsort((pos, doc, context, key))
    key, context, count, doc, pos = (x[order] for x in (key, context, count, doc, pos))
    own = W.heads(key, context)
    size = np.diff(np.r_[own, len(key)])
    first = np.repeat(own, size)
    total = np.add.reduceat(count, own) if len(own) else count
    run = key[own], context[own], np.minimum(total, 2), doc[own], pos[own]
    # Inside the batch: those that a pack has not found before.
    mate = np.where(first == np.arange(len(key)), np.minimum(first + 1, len(key) - 1), first)
    hit = np.flatnonzero(np.repeat(size > 1, size) & (count == 1))
    hits = [(doc[hit], pos[hit], doc[mate[hit]], pos[mate[hit]])]
    # With history: a merge join of its runs, made one, and the batch's run.
    old = merged(runs_in(history)) if history.num_rows else tuple(x[:0] for x in run)
    rank = lower_bound(run[0], run[1], old[0], old[1])
    near = np.minimum(rank, max(0, len(old[0]) - 1))
    there = (old[0][near] == run[0]) & (old[1][near] == run[1]) if len(old[0]) else np.zeros(len(own), bool)
    fresh = np.flatnonzero(there & (run[2] == 1))
    hits.append((run[3][fresh], run[4][fresh], old[3][near[fresh]], old[4][near[fresh]]))
    seen = np.flatnonzero(there)
    once = seen[old[2][near[seen]] == 1]
    hits.append((old[3][near[once]], old[4][near[once]], run[3][once], run[4][once]))
    # Different contexts of one key, in the batch and in history, are compared word by word.
    low, high = np.searchsorted(old[0], run[0], side="left"), np.searchsorted(old[0], run[0], side="right")
    of_key = W.heads(run[0])
    mine = np.diff(np.r_[of_key, len(run[0])])
    kinds = np.repeat(mine, mine) + (high - low)
    kinds -= np.repeat(np.add.reduceat(there.astype(np.int64), of_key), mine) if len(of_key) else 0
    several = kinds > 1
    lead = np.zeros(len(run[0]), bool)
    lead[of_key] = True
    old_of = np.flatnonzero(several & lead)
    spans = high[old_of] - low[old_of]
    old_at = np.repeat(low[old_of] - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
    old_kinds = np.repeat(kinds[old_of], spans)
    need_doc, need_pos = np.r_[run[3][several], old[3][old_at]], np.r_[run[4][several], old[4][old_at]]
    wide = np.r_[kinds[several], old_kinds] > spec.wide
    found = W.hit_table(*W.around(*(np.concatenate(x) for x in zip(*hits)), spec), (need_doc[~wide], need_pos[~wide]), (need_doc[wide], need_pos[wide]))
    found = pa.concat_tables([found, W.passed_on(new)])
    return pa.concat_tables([_both(_run_rows(part, run), 0), _both(found.rename_columns(["hit_doc", *W.HITS.names[1:]]), 1)])


def _both(rows: pa.Table, kind: int) -> pa.Table:
    types = {"kind": pa.int32(), "part": pa.int32(), "hit_doc": pa.int64()}
    columns = {n: rows[n] if n in rows.column_names else pa.nulls(rows.num_rows, types.get(n, pa.binary())) for n in BOTH.names}
    return pa.table(columns | {"kind": pa.array([kind] * rows.num_rows, pa.int32())})


class FingerprintIndex:
    """Runs of window fingerprints by level in a folder. ``add`` merge-joins a batch with all runs, returns its hits and writes the
    new state."""

    def __init__(self, spark: SparkSession, path: str, spec: W.Spec, parts: int, fanout: int = FANOUT, levels: list[list[str]] | None = None, state: int = 0):
        self.spark, self.path, self.spec, self.parts, self.fanout = spark, path, spec, parts, fanout
        self.levels = levels or []
        self.state = state

    @classmethod
    def create(cls, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, seed: int = 0, parts: int | None = None, fanout: int = FANOUT) -> FingerprintIndex:
        return cls(spark, path.rstrip("/"), W.Spec(words=True, window=window, gram=gram, earlier=False, seed=seed), parts or W.parts_of(spark), fanout)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The newest state of the index in a folder."""
        path = path.rstrip("/")
        told = spark.read.text(f"{path}/manifest-*").select(F.from_json("value", "state long, told string").alias("m")).agg(F.max("m")["told"]).first()[0]
        m = json.loads(told)
        return cls(spark, path, W.Spec(words=True, earlier=False, **m["spec"]), m["parts"], m["fanout"], m["levels"], m["state"])

    def _save(self) -> None:
        self.state += 1
        spec = {"window": self.spec.window, "gram": self.spec.gram, "seed": self.spec.seed}
        told = json.dumps({"spec": spec, "parts": self.parts, "fanout": self.fanout, "levels": self.levels, "state": self.state})
        line = json.dumps({"state": self.state, "told": told})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{self.state:09d}")

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], RUN)
        found = [self.spark.read.schema(BOTH).parquet(f"{self.path}/{n}").where("kind = 0").select(*RUN.names) for n in names if n.startswith("batch")]
        if runs := [f"{self.path}/{n}" for n in names if n.startswith("run")]:
            found.append(self.spark.read.schema(RUN).parquet(*runs))
        made = found[0]
        for other in found[1:]:
            made = made.unionByName(other)
        return made

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: (_key, _text), keys not in the index yet. Returns hits (see ``windows.HITS``), also of documents of history."""
        spec = self.spec
        new = W.anchor_rows(batch, spec, self.parts)
        history = self._read([n for level in self.levels for n in level])
        joined = new.groupBy("part").cogroup(history.groupBy("part")).applyInArrow(lambda a, b: freed(join_batch(a, b, spec)), BOTH)
        name = f"batch-{uuid.uuid4().hex}"
        hits = materialize(joined, name, f"{self.path}/{name}").where("kind = 1").select(F.col("hit_doc").alias("doc"), *W.HITS.names[1:])
        self._keep(name, 0)
        self._save()
        return hits

    def _keep(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            every, self.levels[level] = self.levels[level], []
            made = f"run-{level + 1}-{uuid.uuid4().hex}"
            materialize(self._read(every).groupBy("part").applyInArrow(lambda rows: freed(compact(rows)), RUN), made, f"{self.path}/{made}")
            self._keep(made, level + 1)

    def repeats(self, docs: DataFrame, hits: list[DataFrame]) -> DataFrame:
        """(_span_key, _spans) of documents (_key, _text) that hits of batches name; docs has them all, those of history too."""
        every = hits[0]
        for other in hits[1:]:
            every = every.unionByName(other)
        return W.spans_by_doc(W.all_proofs(docs, every, self.spec, self.parts, "index"))


def slices(docs: DataFrame, batches: int) -> list[DataFrame]:
    """Batches by a hash of the key; every one reads the whole table."""
    if batches == 1:
        return [docs]
    return [docs.where(F.pmod(F.xxhash64("_key"), F.lit(batches)) == i) for i in range(batches)]


def by_files(spark: SparkSession, path: str, batches: int = BATCHES) -> list[DataFrame] | None:
    """Batches of a Parquet table by its files, None where it has too few of them."""
    files = sorted(spark.read.parquet(path).inputFiles())
    if len(files) < batches:
        return None
    schema = spark.read.parquet(path).schema
    return [spark.read.schema(schema).parquet(*files[i::batches]) for i in range(batches)]


def remaining(base: DataFrame, spans: DataFrame, docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in [id_col, *keep]]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    others = iter(range(len(keep)))
    extra = ["_text" if c == text_col else f"_k{next(others)}" for c in keep]

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches_, "_text", 2 << 20):
            rows = []
            words = W.Words.of(*utf8(part.column("_text")))
            for a, b, found in zip(words.begin.tolist(), words.begin[1:].tolist(), part.column("_spans").to_pylist()):
                if not found:
                    rows.append((b - a, 0, words.cut(a, b)))
                    continue
                own = W.Words(words.joined, words.place[a : b + 1], np.array([0, b - a]))
                gone = W.proven(W.Units(np.zeros(b - a, np.uint8), own.begin, own), found)
                rows.append((b - a, int(gone.sum()), b" ".join([own.cut(i, i + 1) for i in np.flatnonzero(~gone).tolist()])))
            n, removed, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), *(part.column(c) for c in extra), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema.names
            )

    joined = base.join(spans, F.col("_key") == F.col("_span_key"), "left").select("_id", "_text", "_spans", *[c for c in extra if c != "_text"])
    return joined.mapInArrow(run, schema)


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    batches: int | list[DataFrame] = BATCHES,
    keep: list[str] | None = None,
    path: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """Per row: the id, the columns ``keep``, n_words, n_removed and ``kept`` (the remaining words joined by one space).

    ``batches``: how many, by a hash of the id, or DataFrames that make up ``docs`` (used where ids are whole numbers without
    nulls or repeats, so that they need no numbering). ``path``: the folder of the index, a new one if None."""
    keep = keep or []
    spark = docs.sparkSession
    base = W.keyed(docs, id_col, text_col, [c for c in keep if c != text_col])
    index = FingerprintIndex.create(spark, path or f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}", window, gram, seed)
    if isinstance(batches, int):
        parts = slices(base, batches)
    elif W.natural(base):
        parts = [b.select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).alias("_text")) for b in batches]
    else:
        parts = slices(base, len(batches))
    spans = index.repeats(base, [index.add(b) for b in parts])
    return remaining(base, spans, docs, id_col, text_col, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: what substring dedup leaves of every document; its batches are thirds of the table's files."""
    found = dedup(table(spark, sf_dir, "documents"), batches=by_files(spark, f"{sf_dir}/documents.parquet") or BATCHES)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH b AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, w[i + 1] AS x, CASE WHEN i <= len(w) - 35 THEN array_to_string(list_slice(w, i + 1, i + 35), ' ') END AS s FROM b, unnest(range(0, len(w))) AS r(i)),
m AS (SELECT *, s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 AS hit FROM p),
c AS (SELECT doc_id, i, x, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m)
SELECT b.doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN x END, ' ' ORDER BY i), '')) AS kept_sha256
FROM b LEFT JOIN c USING (doc_id) GROUP BY b.doc_id
"""
