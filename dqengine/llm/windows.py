"""Repeated windows of units (bytes or words) over all documents: what suffix-array and substring dedup share.

Every window of ``window`` units has ``window - gram + 1`` grams; the positions where a window's least gram hash stands are its
anchors. An anchor depends on the window's content alone, so equal windows anywhere have anchors at the same offset, and only
about 2 / (window - gram + 2) of all positions are anchors. An anchor goes with two hashes: the gram's (its key) and that of
all units that windows with this anchor can reach (its context).

1. Anchors are dealt by key in packed rows, one instance of each (key, context) from each of a task's packs: what repeats inside
   a pack is a hit at once and travels in rows that are dealt evenly, so a passage that a third of all documents share sends a
   few bytes a pack to its key and no more.
2. An equal (key, context) is a hit with a mate, the instance it equals. Runs of hits with one mate are fetched from the mate's
   text and compared with the document's own bytes or words before anything is removed (``proofs``, ``proven``).
3. Different contexts of one key are compared unit by unit by suffix sorting, each key in one place. Keys with more than ``WIDE``
   contexts are not gathered: their windows are aggregated by hash, which combines within tasks, joined back, and proven like
   other hits.

Words are compared as words: hashes only find candidates. Should different units ever hash alike, the job stops with an error
that asks for another ``seed``; it never removes units that are not equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm.common import freed, join_hot, materialize, partitions, struct_of, text_slices, utf8
from dqengine.llm.common import offsets as offsets_of

BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB ^ 0x5DEECE66C)
SLICE = 1 << 18
FLUSH = 1 << 18
"""Anchors that a task packs into one set of rows."""
PARTS = 4
"""Parts of the key space for each shuffle partition."""
WIDE = 4096
"""Different contexts of a key beyond which they are not compared in one place."""
SALTS = 16
"""Rows into which the requests to one mate are dealt."""
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_KEPT_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i below n, by doubling; kept for the next call."""
    have = _KEPT_POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, n)
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = min(done, size - done)
            np.multiply(have[:step], np.uint64(pow(base, done, 1 << 64)), out=have[done : done + step])
            done += step
        if n <= 1 << 20:
            _KEPT_POWERS[base] = have
    return have[:n]


class Hashes:
    """Prefix polynomial hashes of a sequence of units: the hash of any stretch in constant time, by wrapping arithmetic
    modulo 2**64 (the base is odd, so it has an inverse)."""

    def __init__(self, units: np.ndarray, base: int = BASES[0]):
        n = len(units)
        base |= 1
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        value = units.astype(np.uint64) + np.uint64(1)
        value *= powers(base, n)
        np.cumsum(value, out=self.prefix[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.prefix) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        h = self.prefix[k:] - self.prefix[: n - k + 1]
        h *= self.inverse[: n - k + 1]
        return mixed(h)

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.inverse[start]


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = op(x[: len(x) - size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


@dataclass
class Words:
    """The words of many texts one after the other: their bytes with a space behind each, where each word begins there, and
    which word each text begins with."""

    joined: np.ndarray
    place: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, at: np.ndarray) -> Words:
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        solid = np.r_[False, ~_SPACE[raw], False]
        start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        place = np.r_[0, np.cumsum(end - start + 1)]
        joined = np.full(place[-1], 32, np.uint8)
        data = raw[solid[1:-1]]
        joined[np.arange(len(data)) + np.repeat(np.arange(len(start)), end - start)] = data
        return cls(joined, place, np.searchsorted(start, at))

    def numbered(self) -> tuple[np.ndarray, list[bytes]]:
        """Numbers that are equal where words are, and the words by number."""
        n = len(self.place) - 1
        offsets = (self.place - np.arange(n + 1)).astype(np.int32)
        keep = np.ones(len(self.joined), bool)
        keep[self.place[1:] - 1] = False
        made = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(self.joined[keep])]).dictionary_encode()
        known, at = made.dictionary.buffers()[2], offsets_of(made.dictionary).tolist()
        data = known.to_pybytes() if known is not None else b""
        return made.indices.to_numpy().astype(np.uint64), [data[a:b] for a, b in zip(at, at[1:])]

    def cut(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one space."""
        return self.joined[self.place[a] : self.place[b] - 1].tobytes() if b > a else b""


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = partial(xxhash.xxh3_64_intdigest, seed=seed) if seed else xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


@dataclass
class Units:
    """What texts are made of: values (bytes, or hashes of words), where each text begins, and the words."""

    values: np.ndarray
    at: np.ndarray
    words: Words | None = None

    def cut(self, a: int, b: int) -> bytes:
        """Units a to b as bytes; words are joined by one space."""
        return self.words.cut(a, b) if self.words is not None else self.values[a:b].tobytes()


@dataclass(frozen=True)
class Spec:
    """What is compared: units, window and gram length; ``earlier``: only windows of documents with a smaller key count."""

    words: bool
    window: int
    gram: int
    earlier: bool
    seed: int = 0
    wide: int = WIDE

    def __post_init__(self):
        if not 0 < self.gram <= self.window:
            raise ValueError(f"a gram of {self.gram} units doesn't fit in a window of {self.window}")

    @property
    def reach(self) -> int:
        """Units before an anchor, and after its gram, that a window with this anchor can hold."""
        return self.window - self.gram

    @property
    def base(self) -> int:
        return BASES[0] + 2 * self.seed

    def units_of(self, raw: np.ndarray, at: np.ndarray) -> Units:
        """Units whose values are not needed."""
        if not self.words:
            return Units(raw, at)
        words = Words.of(raw, at)
        return Units(np.zeros(len(words.place) - 1, np.uint8), words.begin, words)

    def units(self, raw: np.ndarray, at: np.ndarray) -> Units:
        if not self.words:
            return Units(raw, at)
        words = Words.of(raw, at)
        ids, known = words.numbered()
        return Units(word_hashes(known, self.seed)[ids.astype(np.int64)], words.begin, words)


def anchors(units: np.ndarray, at: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, context, text, position in text) of all anchors of many texts laid one after the other."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, w, k = len(units), spec.reach + 1, spec.gram
    if n < spec.window:
        return none
    h = Hashes(units, spec.base)
    gram = h.grams(k)
    np.maximum(gram, np.uint64(1), out=gram)
    least = _sliding(gram, w, np.minimum)  # of the window that starts at each place
    for edge in at[1:-1]:  # windows across texts don't count
        least[max(0, edge - spec.window + 1) : edge] = 0
    wide = np.zeros(len(gram) + w - 1, np.uint64)
    wide[w - 1 : w - 1 + len(least)] = least
    place = np.flatnonzero(_sliding(wide, w, np.maximum) == gram)
    text = np.searchsorted(at, place, side="right") - 1
    left = np.maximum(at[text], place - spec.reach)
    right = np.minimum(at[text + 1], place + k + spec.reach)
    context = mixed(h.of(left, right - left) + (place - left).astype(np.uint64) * np.uint64(BASES[1]) + (right - left).astype(np.uint64) * np.uint64(BASES[2]))
    return gram[place], context, text, place - at[text]


def planes(values: np.ndarray) -> bytes:
    """Differences of neighbours, stored byte by byte of significance so that the shuffle's compression finds the zeros."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(steps, dtype=kind)


def parts_of(spark) -> int:
    return PARTS * partitions(spark)


ANCHORS = struct_of("part int, key binary, context binary, count binary, doc binary, pos binary, hit_doc long, spans binary, mates binary")


def _rows(columns: dict[str, list], schema) -> pa.RecordBatch:
    """A batch of the schema from lists; columns that are left out are null."""
    types = {"integer": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), types[f.dataType.typeName()]) for f in schema], schema.names)


def by_part(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(part, row numbers) of each part that has rows."""
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
    return [(int(part[order[a]]), order[a:b]) for a, b in zip(edges, edges[1:])]


def combined(key: np.ndarray, context: np.ndarray, doc: np.ndarray, pos: np.ndarray, spec: Spec) -> tuple[tuple, tuple]:
    """Of anchors of one pack: (key, context, count, doc, pos) of those that go on, and (doc, pos, mate, mate's pos) of those
    that repeat one of the pack. A count of 2 stands for two or more."""
    order = np.lexsort((pos, doc, context, key))
    key, context, doc, pos = (x[order] for x in (key, context, doc, pos))
    own = heads(key, context)
    size = np.diff(np.r_[own, len(key)])
    first = np.repeat(own, size)
    if spec.earlier:
        hit = doc > doc[first]
        on, mate = np.flatnonzero(~hit), first
    else:
        hit = np.repeat(size > 1, size)
        on, mate = own, np.where(first == np.arange(len(key)), np.minimum(first + 1, len(key) - 1), first)
    count = np.minimum(np.repeat(size, size), 2)[on]
    hit = np.flatnonzero(hit)
    return (key[on], context[on], count, doc[on], pos[on]), (doc[hit], pos[hit], doc[mate[hit]], pos[mate[hit]])


def anchor_rows(docs: DataFrame, spec: Spec, parts: int) -> DataFrame:
    """docs (_key long, _text string) -> packed anchors by part, and rows of hits inside a pack."""

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        on, hit = combined(*(np.concatenate([h[i] for h in held]) for i in range(4)), spec)
        key, context, count, doc, pos = on
        dealt = by_part((key % np.uint64(parts)).astype(np.int32))
        yield _rows(
            {
                "part": [p for p, _ in dealt],
                "key": [key[o].tobytes() for _, o in dealt],
                "context": [context[o].tobytes() for _, o in dealt],
                "count": [planes(count[o]) for _, o in dealt],
                "doc": [planes(doc[o]) for _, o in dealt],
                "pos": [planes(pos[o]) for _, o in dealt],
            },
            ANCHORS,
        )
        if len(hit[0]):
            found = hit_table(*around(*hit, spec))
            hit_doc = found["doc"].to_numpy()
            spread = (mixed(hit_doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
            yield _rows({"part": spread, "hit_doc": hit_doc, "spans": found["spans"].to_pylist(), "mates": found["mates"].to_pylist()}, ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in text_slices(batches, "_text", SLICE):
            units = spec.units(*utf8(part.column("_text")))
            key, context, text, pos = anchors(units.values, units.at, spec)
            if len(key):
                doc = part.column("_key").to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((key, context, doc[text], pos.astype(np.int32)))
                if sum(len(h[0]) for h in held) >= FLUSH:
                    yield from pack(held)
                    held = []
        if held:
            yield from pack(held)

    return docs.select("_key", "_text").mapInArrow(run, ANCHORS)


def unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, context, count, doc, pos) of packed anchors or runs."""

    def joined(read: Callable, name: str, kind: type) -> np.ndarray:
        return np.concatenate([read(d, kind) for d in rows[name].to_pylist() if d is not None] or [np.zeros(0, kind)])

    return joined(np.frombuffer, "key", np.uint64), joined(np.frombuffer, "context", np.uint64), joined(from_planes, "count", np.int64), joined(from_planes, "doc", np.int64), joined(from_planes, "pos", np.int32)


def passed_on(rows: pa.Table) -> pa.Table:
    """The hits that came with the anchors."""
    found = rows.filter(pa.compute.is_valid(rows["hit_doc"]))
    none = pa.array([b""] * found.num_rows, pa.binary())
    return pa.table({"doc": found["hit_doc"], "spans": found["spans"], "mates": found["mates"], "needs": none, "wide": none})


def heads(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted arrays."""
    new = np.ones(len(x), bool)
    if len(x):
        new[1:] = x[1:] != x[:-1]
        for y in more:
            new[1:] |= y[1:] != y[:-1]
    return np.flatnonzero(new)


HITS = struct_of("doc long, spans binary, mates binary, needs binary, wide binary")
"""For a document: spans of units (int32 pairs of start and end) that repeat, for each span the mate's document and how far on
its span lies there (int64 pairs; none if the span is proven), and anchors (int32) whose contexts have to be compared, in one
place for each key or window by window (wide)."""


def around(doc: np.ndarray, pos: np.ndarray, mate: np.ndarray, mate_pos: np.ndarray, spec: Spec) -> tuple:
    """(doc, start, end, mate, shift) of the contexts of anchors that equal others'."""
    pos, mate_pos = pos.astype(np.int64), mate_pos.astype(np.int64)
    return doc, pos - spec.reach, pos + spec.gram + spec.reach, mate, mate_pos - pos


def hit_table(doc: np.ndarray, start: np.ndarray, end: np.ndarray, mate: np.ndarray | None = None, shift: np.ndarray | None = None, needs: tuple = (), wide: tuple = ()) -> pa.Table:
    """One row for each document with spans, needs or wide needs (pairs of document and position)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = np.stack([start, end], 1).astype(np.int32)
    mates = np.stack([mate, shift], 1).astype(np.int64) if mate is not None else np.zeros((len(doc), 0), np.int64)
    columns = [(doc, span), (doc, mates), *((d, p.astype(np.int32)) for d, p in (needs or none, wide or none))]
    every = np.unique(np.concatenate([c[0] for c in columns]))
    made = []
    for d, values in columns:
        order = np.argsort(d, kind="stable")
        d, values = d[order], values[order]
        a, b = np.searchsorted(d, every, side="left"), np.searchsorted(d, every, side="right")
        made.append(pa.array([values[i:j].tobytes() for i, j in zip(a, b)], pa.binary()))
    return pa.table([pa.array(every, pa.int64()), *made], HITS.names)


def runs_of(spans: list[bytes], mates: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(mate, start, end, shift) of a document's hits, those that touch and have one mate and shift taken together."""
    span = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2).astype(np.int64)
    mate = np.frombuffer(b"".join(mates), np.int64).reshape(-1, 2)
    order = np.lexsort((span[:, 0], mate[:, 1], mate[:, 0]))
    span, mate = span[order], mate[order]
    group = heads(mate[:, 0], mate[:, 1])
    edge = np.zeros(len(span), bool)
    edge[group] = True
    which = np.cumsum(edge)
    wide = np.int64(1) << np.int64(33)
    reach = np.maximum.accumulate(span[:, 1] + which * wide) - which * wide  # furthest end so far in the group
    edge[1:] |= span[1:, 0] > reach[:-1]
    at = np.flatnonzero(edge)
    end = np.maximum.reduceat(span[:, 1], at) if len(at) else at
    return list(zip(mate[at, 0].tolist(), span[at, 0].tolist(), end.tolist(), mate[at, 1].tolist()))


REQUESTS = struct_of("mate long, doc long, start int, end int, shift long")
PROOFS = struct_of("doc long, start int, end int, proof binary")


def proofs(docs: DataFrame, hits: DataFrame, spec: Spec) -> DataFrame:
    """For every run of hits the units that its mate has there: (doc, start, end, proof)."""
    found = hits.where(F.length("mates") > 0).groupBy("doc").agg(F.collect_list("spans").alias("spans"), F.collect_list("mates").alias("mates"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, d, a, b, s) for d, spans, mates in zip(*(batch.column(c).to_pylist() for c in ("doc", "spans", "mates"))) for m, a, b, s in runs_of(spans, mates)]
            if rows:
                yield _rows(dict(zip(REQUESTS.names, map(list, zip(*rows)))), REQUESTS)

    asked = found.mapInArrow(ask, REQUESTS).withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    asked = asked.groupBy("mate", "_salt").agg(F.collect_list(F.struct("doc", "start", "end", "shift")).alias("_asked"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_text", SLICE):
            units = spec.units_of(*utf8(part.column("_text")))
            rows, weight = [], 0
            for a, b, asked_ in zip(units.at.tolist(), units.at[1:].tolist(), part.column("_asked").to_pylist()):
                for q in asked_:
                    rows.append((q["doc"], q["start"], q["end"], units.cut(max(a, a + q["start"] + q["shift"]), min(b, a + q["end"] + q["shift"]))))
                    weight += len(rows[-1][3])
                    if weight >= 4 << 20:
                        yield _rows(dict(zip(PROOFS.names, map(list, zip(*rows)))), PROOFS)
                        rows, weight = [], 0
            if rows:
                yield _rows(dict(zip(PROOFS.names, map(list, zip(*rows)))), PROOFS)

    return docs.select("_key", "_text").join(asked, F.col("_key") == F.col("mate")).select("_text", "_asked").mapInArrow(answer, PROOFS)


def compared_spans(hits: DataFrame) -> DataFrame:
    """Hits that were compared unit by unit where they were found, as proofs without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, a, b) for d, s in zip(batch.column("doc").to_pylist(), batch.column("spans").to_pylist()) for a, b in np.frombuffer(s, np.int32).reshape(-1, 2).tolist()]
            if rows:
                yield _rows(dict(zip(PROOFS.names, map(list, zip(*rows)))), PROOFS)

    return hits.where((F.length("spans") > 0) & (F.length("mates") == 0)).select("doc", "spans").mapInArrow(run, PROOFS)


def spans_by_doc(proof: DataFrame) -> DataFrame:
    """(_span_key, _spans): all spans of a document with their proofs; they are no more than a few times its units."""
    return proof.groupBy(F.col("doc").alias("_span_key")).agg(F.collect_list(F.struct("start", "end", "proof")).alias("_spans"))


def proven(units: Units, spans: list[dict] | None) -> np.ndarray:
    """Which units of one text the spans cover, each compared with its proof."""
    n = len(units.values)
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        a, b = max(0, s["start"]), min(n, s["end"])
        if s["proof"] is not None and units.cut(a, b) != s["proof"]:
            raise RuntimeError("different units have equal hashes: run again with another seed")
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:-1]) > 0


CONTEXTS = struct_of("part int, doc binary, pos binary, left binary, size binary, units binary")


def _with_needs(docs: DataFrame, hits: DataFrame, column: str) -> DataFrame:
    needed = hits.where(F.length(column) > 0).groupBy(F.col("doc").alias("_need_key")).agg(F.collect_list(column).alias("_needs"))
    return docs.join(needed, F.col("_key") == F.col("_need_key")).select("_key", "_text", "_needs")


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text number and position of every needed anchor of a batch."""
    wanted = [np.unique(np.frombuffer(b"".join(x), np.int32)) for x in batch.column("_needs").to_pylist()]
    return np.repeat(np.arange(len(wanted)), [len(x) for x in wanted]), np.concatenate(wanted)


def context_rows(docs: DataFrame, hits: DataFrame, spec: Spec, parts: int) -> DataFrame:
    """Contexts of the needed anchors, packed by part of their keys: bytes, or words joined by one space."""

    def pack(held: list[tuple]) -> pa.RecordBatch:
        part, doc, pos, left, size = (np.concatenate([h[i] for h in held]) for i in range(5))
        units = list(chain.from_iterable(h[5] for h in held))
        dealt = by_part(part)
        return _rows(
            {
                "part": [p for p, _ in dealt],
                "doc": [planes(doc[o]) for _, o in dealt],
                "pos": [planes(pos[o]) for _, o in dealt],
                "left": [planes(left[o]) for _, o in dealt],
                "size": [planes(size[o]) for _, o in dealt],
                "units": [(b" " if spec.words else b"").join([units[i] for i in o.tolist()]) for _, o in dealt],
            },
            CONTEXTS,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        for batch in text_slices(batches, "_text", SLICE):
            units = spec.units(*utf8(batch.column("_text")))
            text, pos = _places(batch)
            place = units.at[text] + pos
            left = np.maximum(units.at[text], place - spec.reach)
            right = np.minimum(units.at[text + 1], place + spec.gram + spec.reach)
            key = Hashes(units.values, spec.base).grams(spec.gram)[place]
            np.maximum(key, np.uint64(1), out=key)
            cut = [units.cut(a, b) for a, b in zip(left.tolist(), right.tolist())]
            docs_ = batch.column("_key").to_numpy(zero_copy_only=False).astype(np.int64)
            held.append(((key % np.uint64(parts)).astype(np.int32), docs_[text], pos, (place - left).astype(np.int32), (right - left).astype(np.int32), cut))
            weight += sum(map(len, cut))
            if weight >= 4 << 20:
                yield pack(held)
                held, weight = [], 0
        if held:
            yield pack(held)

    return _with_needs(docs, hits, "needs").mapInArrow(run, CONTEXTS)


WINDOWS = struct_of("one long, two long, doc long, start int")


def wide_hits(docs: DataFrame, hits: DataFrame, spec: Spec) -> DataFrame:
    """Hits of windows around anchors whose keys have too many contexts for one place: windows are aggregated by two hashes, which
    combines within tasks, and joined back with the first and last one of theirs."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text", SLICE):
            units = spec.units(*utf8(batch.column("_text")))
            text, pos = _places(batch)
            place = units.at[text] + pos
            low, high = np.maximum(units.at[text], place - spec.reach), np.minimum(place, units.at[text + 1] - spec.window)
            count = np.maximum(0, high - low + 1)
            start = np.unique(np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count))
            if len(start):
                of = np.searchsorted(units.at, start, side="right") - 1
                one, two = (Hashes(units.values, b + 2 * spec.seed).grams(spec.window)[start].view(np.int64) for b in BASES[:2])
                doc = batch.column("_key").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(doc[of]), pa.array((start - units.at[of]).astype(np.int32))], WINDOWS.names)

    rows = materialize(_with_needs(docs, hits, "wide").mapInArrow(windows, WINDOWS), "wide-windows")
    place = F.struct("doc", "start")
    ends = rows.groupBy(F.col("one").alias("_one"), F.col("two").alias("_two")).agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("_n"))
    ends = materialize(ends.where(F.col("_first.doc") < F.col("_last.doc") if spec.earlier else F.col("_first") < F.col("_last")), "wide-ends")
    joined = join_hot(rows, ["one", "two"], ends, ["_one", "_two"], "_n")
    mate = F.col("_first") if spec.earlier else F.when(place == F.col("_first"), F.col("_last")).otherwise(F.col("_first"))
    found = (joined.where(F.col("doc") > F.col("_first.doc")) if spec.earlier else joined).withColumn("_mate", mate)
    found = found.select("doc", F.col("start").cast("long").alias("start"), F.col("_mate.doc").alias("mate"), (F.col("_mate.start") - F.col("start")).cast("long").alias("shift"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, mate_, shift = (batch.column(i).to_numpy() for i in range(4))
            yield from hit_table(doc, start, start + spec.window, mate_, shift).to_batches()

    return found.mapInArrow(pack, HITS)


@dataclass
class Suffixes:
    """Suffixes of contexts that start at their anchors, with hashes for comparing them."""

    units: np.ndarray
    start: np.ndarray
    end: np.ndarray
    begin: np.ndarray
    hashes: Hashes

    def extension(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b, at most ``most``: binary search on prefix hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(np.minimum(self.end[a] - self.start[a], self.end[b] - self.start[b]), most)
        for _ in range(int(most).bit_length()):
            mid = (low + high + 1) >> 1
            equal = self.hashes.of(self.start[a], mid) == self.hashes.of(self.start[b], mid)
            low = np.where(equal, mid, low)
            high = np.where(equal, high, mid - 1)
        return low

    def after(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """1, 0 or -1 as suffix a sorts after, like or before b; a suffix that ends sorts before its extensions."""
        n = self.extension(a, b, most)
        x, y = self.start[a] + n, self.start[b] + n
        a_over, b_over = (x >= self.end[a]) | (n >= most), (y >= self.end[b]) | (n >= most)
        last = len(self.units) - 1
        u, v = self.units[np.minimum(x, last)], self.units[np.minimum(y, last)]
        both = (u > v).astype(np.int8) - (u < v).astype(np.int8)
        return np.where(a_over & b_over, 0, np.where(a_over, -1, np.where(b_over, 1, both))).astype(np.int8)


def suffix_order(s: Suffixes, order: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Sorts the suffixes of each group (neighbours in ``order``, told apart by ``group``) by merging runs of doubling length.
    All pairs of runs are merged at once: each suffix finds its rank in the other run by binary search."""
    order = order.copy()
    head = heads(group)
    size = np.diff(np.r_[head, len(group)])
    first, total = np.repeat(head, size), np.repeat(size, size)
    local = np.arange(len(order)) - first
    width = 1
    while len(size) and width < size.max():
        active = np.flatnonzero(total > width)
        mine, run = local[active], local[active] // width
        other = (run ^ 1) * width
        low = np.minimum(other, total[active])
        high = np.minimum(other + width, total[active])
        base, right = low.copy(), (run & 1).astype(bool)
        item = order[active]
        offset = first[active]
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            sign = s.after(item[open_], order[offset[open_] + mid], most)
            # Equal suffixes of the left run stay before those of the right one.
            beyond = (sign > 0) | ((sign == 0) & right[open_])
            low[open_] = np.where(beyond, mid + 1, low[open_])
            high[open_] = np.where(beyond, high[open_], mid)
        pair = (run >> 1) * 2 * width
        order[offset + pair + (mine - run * width) + (low - base)] = item
        width *= 2
    return order


def compare_contexts(rows: pa.Table, spec: Spec) -> pa.Table:
    """Spans of windows that repeat among different contexts of a key: suffix array of the anchors' suffixes, common
    extensions of neighbours, and for every split of a window into what lies before and after the anchor the groups of
    equal windows. Equality by hash is verified unit by unit; a collision starts over with another base."""
    doc, pos, left, size = (np.concatenate([from_planes(d, kind) for d in rows[name].to_pylist()] or [np.zeros(0, kind)]).astype(np.int64) for name, kind in (("doc", np.int64), ("pos", np.int32), ("left", np.int32), ("size", np.int32)))
    raw = np.frombuffer((b" " if spec.words else b"").join(rows["units"].to_pylist()), np.uint8)
    units = Words.of(raw, np.array([0, len(raw)])).numbered()[0] if spec.words else raw
    begin = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
    for base in BASES:
        found = _compare(Suffixes(units, begin + left, begin + size, begin, Hashes(units, base)), doc, spec)
        if found is not None:
            break
    else:
        raise RuntimeError("window hashes collide under every base")
    before, behind = found
    hit = np.flatnonzero(behind > 0)
    return hit_table(doc[hit], pos[hit] - before[hit], pos[hit] + behind[hit])


def _compare(s: Suffixes, doc: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray] | None:
    """Most units before and from each anchor that repeated windows cover; None if a hash collision was met."""
    n, most = len(doc), spec.window
    before, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return before, behind
    key = s.hashes.of(s.start, spec.gram)
    order = np.argsort(key, kind="stable")
    order = suffix_order(s, order, key[order], most)
    new = np.r_[True, key[order[1:]] != key[order[:-1]]]
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    common[1:] = np.where(new[1:], 0, s.extension(a, b, most))
    for d in range(int(common.max(initial=0))):
        at = np.flatnonzero(common[1:] > d)
        if (s.units[s.start[a[at]] + d] != s.units[s.start[b[at]] + d]).any():
            return None
    by_doc = np.argsort(doc[order], kind="stable")
    for after in range(spec.gram, spec.window + 1):
        ahead = spec.window - after
        run = np.cumsum(common < after)[by_doc]
        item = order[by_doc]
        fits = np.flatnonzero((s.end[item] - s.start[item] >= after) & (s.start[item] - s.begin[item] >= ahead))
        item, run = item[fits], run[fits]
        if len(item) < 2:
            continue
        value = mixed(s.hashes.of(s.start[item] - ahead, ahead) + run.astype(np.uint64) * np.uint64(BASES[2]))
        rank = np.argsort(value, kind="stable")
        item, run, value = item[rank], run[rank], value[rank]
        head = heads(value)
        count = np.diff(np.r_[head, len(value)])
        lead = np.repeat(head, count)
        if spec.earlier:
            marked = np.flatnonzero(doc[item] > doc[item[lead]])
            mate = lead[marked]
        else:
            marked = np.flatnonzero(np.repeat(count, count) > 1)
            mate = np.where(lead[marked] == marked, marked + 1, lead[marked])
        if (run[marked] != run[mate]).any():
            return None
        for d in range(1, ahead + 1):
            if (s.units[s.start[item[marked]] - d] != s.units[s.start[item[mate]] - d]).any():
                return None
        before[item[marked]] = np.maximum(before[item[marked]], ahead)
        behind[item[marked]] = np.maximum(behind[item[marked]], after)
    return before, behind


def compared(docs: DataFrame, hits: DataFrame, spec: Spec, parts: int) -> DataFrame:
    """Hits from comparing contexts unit by unit."""
    rows = context_rows(docs, hits, spec, parts)
    return rows.groupBy("part").applyInArrow(lambda table: freed(compare_contexts(table, spec)), HITS)


def all_proofs(docs: DataFrame, hits: DataFrame, spec: Spec, parts: int, name: str) -> DataFrame:
    """(doc, start, end, proof) of everything that hits lead to, written out."""
    more = materialize(compared(docs, hits, spec, parts), f"{name}-compared")
    wide = hits.where(F.length("wide") > 0)
    if not wide.isEmpty():
        hits = hits.unionByName(materialize(wide_hits(docs, wide, spec), f"{name}-wide"))
    return materialize(proofs(docs, hits, spec), f"{name}-proofs").unionByName(compared_spans(more))


def natural(keyed_docs: DataFrame) -> bool:
    """Whether ``keyed`` left the ids as they are."""
    return isinstance(keyed_docs.schema["_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) and "_numbered" not in keyed_docs.columns


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """(_key, _id, _text, kept columns as _k0, ...): _key is the id where ids are whole numbers without nulls or repeats;
    else rows are numbered in order of id (null last) and text, so that each row is a document of its own."""
    extra = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep or [])]
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *extra)
    whole = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if whole and base.groupBy("_id").count().where("`count` > 1 or _id is null").isEmpty():
        return base.withColumn("_key", F.col("_id").cast("long"))
    ordered = base.orderBy(F.col("_id").asc_nulls_last(), F.col("_text").asc_nulls_last())
    return materialize(ordered.withColumn("_key", F.monotonically_increasing_id()).withColumn("_numbered", F.lit(True)), "keyed")
