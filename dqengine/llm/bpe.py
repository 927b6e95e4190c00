"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks file gives bytes and ranks. The tokenizers library works on characters, so each byte gets a printable stand-in
(the usual byte-to-character table) and every split of a token into two known tokens becomes a merge of the token's rank;
that makes the library merge what a rank-driven encoder merges. A worker hands it each different match of the pattern once. Decoding reverses the table: ids become bytes first and
text last, so a character split over several tokens comes back whole.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dqengine.llm.common import plain_strings, sha256, table, text_slices

SLICE = 1 << 20
"""Bytes of text encoded at once; bounds the memory of the library's result objects."""
KEPT = 1 << 18
"""Different matches whose ids a worker keeps; when there are more it begins anew."""
LONGEST = 64
"""Characters of a match whose ids are kept."""


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str | None = None):
    """(tokenizer, bytes of each id, length of each id's bytes) for a ranks file; built once a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    stand_in = byte_characters()
    shown = {token: "".join(map(stand_in.__getitem__, token)) for token in ranks}
    merges = [
        (shown[token[:i]], shown[token[i:]])
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    made = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True, cache_capacity=100_000))
    if pattern is None or pattern == public_tokenizers.PATTERN:
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    else:
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    back = {character: byte for byte, character in enumerate(stand_in)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for text, rank in made.get_vocab().items():
        tokens[rank] = bytes(map(back.__getitem__, text))
    return made, tokens, np.array([len(t) for t in tokens], np.int64)


@functools.lru_cache(maxsize=4)
def known_ids(path: str) -> dict[str, bytes]:
    """Ids of the matches that a Python worker has met."""
    return {}


@functools.lru_cache(maxsize=1)
def splitter():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def _matches(text: str) -> Iterator[list[str]]:
    """The matches of the usual pattern, which leave nothing out; those of a long text in parts."""
    if len(text) <= SLICE:
        yield splitter().findall(text)
    else:
        found = (m.group() for m in splitter().finditer(text))
        while part := list(islice(found, SLICE // 8)):
            yield part


def encoded(texts: list[str], path: str, pattern: str | None = None) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers. Matches are encoded separately, so the library
    gets each different match once for as long as a worker keeps its ids; a pattern of one's own gives it whole texts."""
    import public_tokenizers

    made, _, _ = codec(path, pattern)
    in_library = lambda many: [np.array(e.ids, "<u4").tobytes() for e in made.encode_batch_fast(many, add_special_tokens=False)]
    if pattern is not None and pattern != public_tokenizers.PATTERN:
        return in_library(texts)
    known, out = known_ids(path), []
    for text in texts:
        ids = []
        for part in _matches(text):
            if new := list(set(part).difference(known)):
                known.update(zip(new, in_library(new)))
            ids.append(b"".join(map(known.__getitem__, part)))
            for match in new:
                if len(match) > LONGEST:
                    del known[match]
            if len(known) > KEPT:
                known.clear()
        out.append(b"".join(ids))
    return out


def decode_ids(ids, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """One row per document: its id, ``ids`` array<int> and, if asked for, ``byte_ends`` array<int> (where each token ends in
    the UTF-8 text) and ``char_spans`` array<struct<start,end>> (the characters it touches).

    A null text is empty and has no ids. Repeated rows and rows of one id are encoded each; nothing is ordered, so there are no
    ties; an empty table gives no rows. Only the two columns named are read, so other columns do not matter, whatever their
    names. A text is encoded whole whatever its length. A null id stays null.
    """
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if offsets:
        schema = schema.add("byte_ends", T.ArrayType(T.IntegerType())).add("char_spans", spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, _, lengths = codec(path, pattern)
        for part in text_slices(batches, text_col, SLICE):
            texts = plain_strings(part, text_col)
            if not offsets:
                ids = encoded(texts, path, pattern)
                ends = np.cumsum([0, *map(len, ids)]) // 4
                out = [part.column(id_col), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))]
            else:
                found = made.encode_batch(texts, add_special_tokens=False)
                out = [part.column(id_col), pa.array([e.ids for e in found], pa.list_(pa.int32()))]
                out.append(pa.array([np.cumsum(lengths[e.ids]).tolist() if e.ids else [] for e in found], pa.list_(pa.int32())))
                out.append(pa.array([[{"start": a, "end": b} for a, b in e.offsets] for e in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(tokens_df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", pattern: str | None = None) -> DataFrame:
    """One row per row: the id, ``bytes`` (the decoded bytes) and ``text`` (those as UTF-8; a character that the ids cut off
    becomes U+FFFD).

    Null ids are none and give no bytes. Repeated rows and rows of one id are decoded each; an empty table gives no rows; only
    the two columns named are read, so names of others can't clash. An id outside the ranks stops the job with an IndexError.
    """
    schema = T.StructType([T.StructField(id_col, tokens_df.schema[id_col].dataType), T.StructField("bytes", T.BinaryType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens, _ = codec(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                data = [decode_ids(ids or [], tokens) for ids in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data], pa.string())], schema.names)

    return tokens_df.select(id_col, ids_col).mapInArrow(run, schema)


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def round_trip(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass over the Arrow batches and keeps only counts and digests of both.

    A null text is the empty one: no tokens, digests of no bytes. Texts are taken whole, long ones one at a time; repeated rows
    and rows of one id give a row each; nothing is ordered, so there are no ties; an empty table gives no rows. Only the two
    columns named are read, so names of others can't clash.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *DIGESTS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens, _ = codec(path, pattern)
        for part in text_slices(batches, text_col, SLICE):
            ids = encoded(plain_strings(part, text_col), path, pattern)
            rows = [(len(x) // 4, sha256(x), sha256(decode_ids(np.frombuffer(x, "<u4").tolist(), tokens))) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array(c) for c in zip(*rows))], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: digests of ids and decoded bytes for every document."""
    return round_trip(table(spark, sf_dir, "documents"), ranks_path())
