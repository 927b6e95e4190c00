"""Suffix-array dedup: removing bytes that an earlier document already has.

Every byte covered by a string of ``window`` bytes that also starts in a document with a smaller id goes; strings are judged on
the input and never cross documents. The suffix array is sparse: it holds the suffixes at anchors (see ``windows``), of which
every window has one. Suffixes are compared by prefix polynomial hashes: a binary search finds the common extension of two of
them in logarithmically many steps, a mergesort orders them, and what the hashes call equal is verified byte by byte: inside
the sort where contexts differ, against the bytes of the instance it equals where a whole context repeats.

A null text is empty. A repeated id, a null id or an id that is no whole number counts as a document after the earlier rows of
that id, in order of text; null ids come last; repeated rows of one id are ties and lose what an equal row before them has.
Texts shorter than the window lose nothing; very long texts are read whole, one at a time; an empty table gives no rows. Other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm import windows as W
from dqengine.llm.common import freed, materialize, table, text_slices

WINDOW = 50


def first_hits(rows: pa.Table, spec: W.Spec) -> pa.Table:
    """Of the anchors of a part: hits of those whose context an earlier document has, and anchors to compare further."""
    key, context, _, doc, pos = W.unpack(rows)
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = W.heads(key)
    size = np.diff(np.r_[head, len(key)])
    many = np.repeat(size > 1, size)
    order, key = order[many], key[many]
    context, doc, pos = context[order], doc[order], pos[order].astype(np.int64)
    order = np.lexsort((pos, doc, context, key))
    key, context, doc, pos = key[order], context[order], doc[order], pos[order]
    head = W.heads(key)
    size = np.diff(np.r_[head, len(key)])
    spread = np.repeat(np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head), size) if len(head) else np.zeros(0, bool)
    own = W.heads(key, context)
    first = np.repeat(own, np.diff(np.r_[own, len(key)]))
    later = doc > doc[first]
    kinds = np.repeat(np.add.reduceat(np.isin(np.arange(len(key)), own, assume_unique=True).astype(np.int64), head), size) if len(head) else np.zeros(0, np.int64)
    open_ = spread & ~later & (kinds > 1)
    needs, wide = open_ & (kinds <= spec.wide), open_ & (kinds > spec.wide)
    found = W.hit_table(*W.around(doc[later], pos[later], doc[first[later]], pos[first[later]], spec), (doc[needs], pos[needs]), (doc[wide], pos[wide]))
    return pa.concat_tables([found, W.passed_on(rows)])


def repeats(docs: DataFrame, spec: W.Spec) -> DataFrame:
    """(_span_key, _spans) of documents (_key, _text) that have bytes to remove."""
    parts = W.parts_of(docs.sparkSession)
    hits = W.anchor_rows(docs, spec, parts).groupBy("part").applyInArrow(lambda rows: freed(first_hits(rows, spec)), W.HITS)
    hits = materialize(hits, "suffix-hits")
    return W.spans_by_doc(W.all_proofs(docs, hits, spec, parts, "suffix"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int | None = None, seed: int = 0) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, ``kept`` (the remaining bytes) and ``removed`` (spans of bytes)."""
    base = W.keyed(docs, id_col, text_col)
    spec = W.Spec(words=False, window=window, gram=gram or max(1, window * 2 // 5), earlier=True, seed=seed)
    spans = repeats(base, spec)
    own = T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start int, end int>>")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *own.fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_text", 2 << 20):
            rows = []
            for text, found in zip(part.column("_text").to_pylist(), part.column("_spans").to_pylist()):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                if not found:
                    rows.append((len(raw), 0, 0, raw.tobytes(), []))
                    continue
                gone = W.proven(W.Units(raw, np.array([0, len(raw)])), found)
                edge = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
                rows.append((len(raw), int(gone.sum()), len(edge) // 2, raw[~gone].tobytes(), [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary()), pa.array(columns[4], kind)], schema.names
            )

    joined = base.join(spans, F.col("_key") == F.col("_span_key"), "left").select("_id", "_text", "_spans")
    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: what suffix-array dedup leaves of every document."""
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, CASE WHEN i <= n - 50 THEN substr(h, 2 * i + 1, 100) END AS s, substr(h, 2 * i + 1, 2) AS x FROM b, unnest(range(0, n)) AS r(i)),
f AS (SELECT s, min(doc_id) AS first FROM w WHERE s IS NOT NULL GROUP BY s),
m AS (SELECT w.doc_id, w.i, w.x, coalesce(f.first < w.doc_id, false) AS hit FROM w LEFT JOIN f USING (s)),
c AS (SELECT doc_id, i, x, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c)
SELECT b.doc_id, CAST(any_value(n) AS BIGINT) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
  sha256(unhex(coalesce(string_agg(CASE WHEN NOT gone THEN x END, '' ORDER BY i), ''))) AS kept_sha256
FROM b LEFT JOIN e USING (doc_id) GROUP BY b.doc_id
"""
