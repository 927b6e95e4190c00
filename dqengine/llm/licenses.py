"""License scans: fuzzy search for short notices.

Every notice may differ by a tenth of its characters, ``k`` edits. Cut into k + 1 pieces, at least one piece stands unchanged
in any such copy (pigeonhole), so an automaton of all pieces finds every candidate place in one pass; the regex library then
matches the notice with at most k errors in the few characters around it and reports span and errors.

Texts are compared as words: A-Z lower-cased, runs of digits, a-z and anything beyond ASCII, joined by one space. A null text
has no words, an empty one no spans. Rows are independent: repeated rows and other columns don't matter; texts are scanned
whole, in time that grows with their length and their notices; an empty table gives no rows. Notices that overlap with equally
many errors are ties and all reported.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm.common import LOWER, table, text_slices

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
"""Phrases whose words have to stand consecutively, and their labels."""

NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("proprietary", "all rights reserved no part of this may be reproduced"),
)
ERROR_SHARE = 0.1

_WORDS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in LOWER)
SPANS = "array<struct<label string, start_word int, end_word int, errors int, similarity double>>"


def words(text: str) -> list[bytes]:
    """The words of a text: its UTF-8 bytes, lower-cased and split at ASCII that is neither digit nor letter."""
    return text.encode().translate(_WORDS).split()


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cut = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


@functools.lru_cache(maxsize=4)
def _scanner(notices: tuple[tuple[str, str], ...], share: float):
    import ahocorasick
    import regex

    patterns, seeds = [], {}
    for i, (label, notice) in enumerate(notices):
        k = int(len(notice) * share)
        for offset, piece in pieces(notice, k):
            seeds.setdefault(piece, []).append((i, offset))
        # The notice's words have to begin and end at words of the text.
        patterns.append((label, notice, k, regex.compile(rf"(?b)(?<=^| )(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?= |$)")))
    automaton = ahocorasick.Automaton()
    for piece, where in seeds.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, patterns


def fuzzy(line: str, notices: tuple[tuple[str, str], ...] = NOTICES, share: float = ERROR_SHARE) -> list[tuple[str, int, int, int, float]]:
    """(label, start, end, errors, similarity) of every notice in a line of normalized words; offsets are the line's. ``line``
    holds the words' UTF-8 bytes read as Latin-1, so that a character is a byte."""
    automaton, patterns = _scanner(notices, share)
    starts: dict[int, set[int]] = {}
    for end, (size, where) in automaton.iter(line):
        for i, offset in where:
            starts.setdefault(i, set()).add(end + 1 - size - offset)
    found = set()
    for i, places in starts.items():
        label, notice, k, pattern = patterns[i]
        for first, last in near_places(sorted(places), 2 * k + 1, len(notice)):
            for m in pattern.finditer(line, max(0, first - k - 1), min(len(line), last + len(notice) + k + 1)):
                errors = sum(m.fuzzy_counts)
                found.add((label, m.start(), m.end(), errors, 1 - errors / len(notice)))
    return clearest(list(found))


def near_places(places: list[int], gap: int, most: int) -> Iterator[tuple[int, int]]:
    """First and last of neighbours that are no further apart than ``gap``; none spans more than ``most``."""
    first = last = None
    for p in places:
        if first is None or p - last > gap or p - first > most:
            if first is not None:
                yield first, last
            first = p
        last = p
    if first is not None:
        yield first, last


def clearest(found: list[tuple]) -> list[tuple]:
    """Of overlapping spans those with the fewest errors, for notices that differ by a digit or two lie within each other's
    errors; sorted by place. Kept spans stand in order of start, and only those that start within the longest span are met."""
    longest = max((hit[2] - hit[1] for hit in found), default=0)
    starts: list[int] = []
    kept: list[tuple] = []
    for hit in sorted(found, key=lambda x: (x[3], x[1], x[0])):
        near = kept[bisect.bisect_left(starts, hit[1] - longest) : bisect.bisect_left(starts, hit[2])]
        if all(hit[1] >= other[2] or hit[2] <= other[1] or hit[3] == other[3] for other in near):
            at = bisect.bisect_right(starts, hit[1])
            starts.insert(at, hit[1])
            kept.insert(at, hit)
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def base_hits(line: bytes, phrases: dict[str, str]) -> list[tuple[str, int]]:
    """(label, offset) of every place of every phrase; line begins and ends with a space."""
    found = []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at = line.find(needle)
        while at >= 0:
            found.append((label, at))
            at = line.find(needle, at + 1)
    return found


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] | None = None,
    notices: tuple[tuple[str, str], ...] = NOTICES,
    share: float = ERROR_SHARE,
) -> DataFrame:
    """Per row: the id, n_words, ``base`` and ``fuzzy`` (arrays of spans in words with label, errors and similarity)."""
    base = BASE if base is None else base
    own = T._parse_datatype_string(f"n_words long, base {SPANS}, fuzzy {SPANS}")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *own.fields])
    kind = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("errors", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col, 2 << 20):
            counts, bases, fuzzies = [], [], []
            for text in part.column(text_col).to_pylist():
                own_words = words(text or "")
                line = b" %b " % b" ".join(own_words)
                spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                place = lambda at: int(np.searchsorted(spaces, at, side="right")) - 1  # noqa: B023, E731  the word that starts after the space at ``at``
                counts.append(len(own_words))
                bases.append([{"label": label, "start_word": place(at), "end_word": place(at) + size, "errors": 0, "similarity": 1.0} for phrase, label in base.items() for size in (len(phrase.split()),) for _, at in base_hits(line, {phrase: label})])
                hits = fuzzy(line[1:-1].decode("latin-1"), notices, share)
                fuzzies.append([{"label": label, "start_word": place(a), "end_word": place(b), "errors": e, "similarity": s} for label, a, b, e, s in hits])
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(counts, pa.int64()), pa.array(bases, kind), pa.array(fuzzies, kind)], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: words, base places and labels of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    every = F.concat(F.col("base"), F.col("fuzzy"))
    starts = F.col("base.start_word")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.concat(F.col("base.label"), F.col("fuzzy.label"))).alias("labels"),
        F.coalesce(F.array_max(F.transform(every, lambda x: x["similarity"])), F.lit(0.0)).alias("score"),
    )


# Base places in SQL; the method's own labels and score go beyond it and are tested by brute force.
_PHRASES = ", ".join(f"('{phrase}', '{label}')" for phrase, label in BASE.items())
BASE_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
hits AS (
  SELECT doc_id, label, i FROM words, (VALUES {_PHRASES}) AS p(phrase, label),
    unnest(range(0, len(w))) AS r(i) WHERE w[i + 1] = split_part(phrase, ' ', 1)
    AND list_slice(w, i + 1, i + len(string_split(phrase, ' '))) = string_split(phrase, ' '))
SELECT words.doc_id, any_value(len(w)) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM words LEFT JOIN hits USING (doc_id) GROUP BY words.doc_id
"""
