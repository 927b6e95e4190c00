"""The pipeline against its stages worked out plainly, and the registered queries."""

import duckdb
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from dqengine.llm import bpe, licenses, registry
from dqengine.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    long = " ".join(f"w{i}" for i in range(90))
    near = long.replace("w50 ", "changed ")
    rows = [(i, f"plain text number {i} about {i * i} things " * 3, "en", "ab"[i % 2], 1, "x") for i in range(20)]
    rows += [(30, long, "en", "a", 1, "y"), (31, near, "en", "a", 1, "y"), (32, "before " + passage + " after", "en", "b", 1, None), (33, passage + " end", None, None, None, "z"), (34, None, None, None, None, None), (None, "", "en", "a", 0, "")]
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long").add("kept", "string")
    return spark.createDataFrame(rows, schema)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage_keeps_the_columns(spark, docs):
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = materialize(stage(spark, at, SF), name)
        assert at.columns == docs.columns and [f.dataType for f in at.schema] == [f.dataType for f in docs.schema]
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert last.count() == at.count() and last.columns == ["doc_id", "n_tokens", "ids"]


def test_near_duplicates_go(spark, docs):
    got = by_id(corpus_pipeline.drop_near_duplicates(spark, docs, SF))
    assert set(by_id(docs)) - set(got) == {31, 33} and got[32].kept is None and got[30].kept == "y"


def test_passages_go(spark, docs):
    got = by_id(corpus_pipeline.drop_repeated_passages(spark, docs.where("doc_id >= 32 or doc_id < 5"), SF))
    assert (got[32].text, got[32].n_chars, got[33].text, got[34].text) == ("before after", 12, "end", None)
    assert got[3].text == by_id(docs)[3].text and got[3].n_chars == 1


def test_toxic_documents_go(spark, docs, tmp_path):
    """Labels teach a word; documents with it go, labelled or not, equal rows together; null and empty texts stay."""
    plain = [f"calm words number {i} about rivers and hills" for i in range(120)]
    rows = [(i, t + (" you blorgface" if i % 4 == 0 else ""), "en", "a", 1) for i, t in enumerate(plain)]
    rows += [(200, "such a blorgface again", "en", "a", 1), (200, "such a blorgface again", "en", "a", 1), (201, None, None, None, None), (202, "", "en", "a", 0), (203, "rivers and hills", "en", "a", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = sorted(r.doc_id for r in corpus_pipeline.drop_toxic(spark, table, str(tmp_path)).collect())
    assert left == [i for i in range(120) if i % 4] + [201, 202, 203]


def test_tokens_decode_to_the_texts(spark, docs):
    got = corpus_pipeline.tokenize(spark, docs, SF).collect()
    _, tokens, _ = bpe.codec(bpe.ranks_path())
    texts = sorted(r.text or "" for r in docs.collect())
    assert sorted(bpe.decode_ids(r.ids, tokens).decode() for r in got) == texts and all(r.n_tokens == len(r.ids) for r in got)


def test_mixing_repeats_rows(spark, docs):
    got = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()]
    assert max(got.count(i) for i in set(got)) <= 2 and None not in got and 34 not in got


def test_empty_documents(spark, docs):
    at = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, SF), name)
    assert at.count() == 0


def test_queries_of_the_registry(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").count()
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    convs = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    for name, query in registry.queries().items():
        found = query(spark, SF).count()
        if name.startswith("op12_"):
            assert found > convs
        else:
            assert found == (pages if name.startswith("op4_") else convs if name.startswith("op13_") else rows), name


@pytest.mark.parametrize("name", [n for n in registry.oracle_sql() if not n.startswith(("op12_", "op13_"))])  # these have tests of their own
def test_twin(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df().set_index("doc_id").sort_index()
    got = registry.queries()[name](spark, SF).toPandas().set_index("doc_id").sort_index()
    assert (got[list(want)] == want).all().all()


def test_license_base_places_in_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(licenses.BASE_SQL).df().set_index("doc_id").sort_index()
    got = licenses.query(spark, SF).toPandas().set_index("doc_id").sort_index()
    for c in want:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
    assert (got.score <= 1).all() and ((got.labels != "") == (got.score > 0)).all()
