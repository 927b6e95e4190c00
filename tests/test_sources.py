"""Bad rows and files are set apart, with the file and the reason."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from dqengine.sources import tables
from dqengine.sources.checked import read_checked


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def names(df):
    return sorted((r.file.rsplit("/", 1)[-1], r.reason, r.record) for r in df.collect())


def test_malformed_csv_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"a,b,c\n1,x,2.5\n2,y\n3,z,4.5,9\n4,\"multi\nline\",NA\n5,caf\xe9,1.0\n6,w,0.5\n")
    found = read_checked(spark, str(tmp_path / "t.csv"))
    assert [r[0] for r in rows(found.good)] == [1, 4, 6] and found.good.columns == ["a", "b", "c"]
    bad = names(found.rejected)
    assert [b[:2] for b in bad] == [("t.csv", "encoding"), ("t.csv", "malformed"), ("t.csv", "malformed")]
    assert {b[2] for b in bad if b[1] == "malformed"} == {"2,y", "3,z,4.5,9"} and "caf" in bad[0][2]
    typed = read_checked(spark, str(tmp_path / "t.csv"), tables.T.StructType().add("a", "long").add("b", "long").add("c", "string"))
    assert typed.good.count() == 0 and typed.rejected.count() == 6


def test_malformed_json_rows(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a": 1, "_bad_record": "kept"}\n{"a": \nnot json\n{"a": 2, "_bad_record": null}\n')
    found = read_checked(spark, str(tmp_path / "t.jsonl"))
    assert rows(found.good.select("a", "_bad_record")) == [(1, "kept"), (2, None)]
    assert names(found.rejected) == [("t.jsonl", "malformed", "not json"), ("t.jsonl", "malformed", '{"a": ')]
    (tmp_path / "none.json").write_text("nothing\nhere\n")
    with pytest.raises(tables.UnreadableFile):
        read_checked(spark, str(tmp_path / "none.json"))


def test_damaged_parquet_files(spark, tmp_path):
    folder = tmp_path / "t.parquet"
    folder.mkdir()
    for i in range(4):
        pq.write_table(pa.table({"a": list(range(i * 1000, i * 1000 + 1000)), "b": [f"text {j * 7919 % 1000}" for j in range(1000)]}), folder / f"p{i}.parquet", row_group_size=200, compression="gzip")
    pq.write_table(pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.string())}), folder / "empty.parquet")
    whole = (folder / "p1.parquet").read_bytes()
    at = len(whole) // 2
    (folder / "p1.parquet").write_bytes(whole[:at] + bytes(x ^ 0x5A for x in whole[at : at + 400]) + whole[at + 400 :])
    (folder / "p2.parquet").write_bytes((folder / "p2.parquet").read_bytes()[:-20])
    (folder / "p3.parquet").write_bytes(b"no table at all")
    found = read_checked(spark, str(folder), tables.T.StructType().add("a", "long").add("b", "string"))
    assert [n[:2] for n in names(found.rejected)] == [(f"p{i}.parquet", "damaged") for i in (1, 2, 3)]
    assert sorted(r.a for r in found.good.collect()) == list(range(1000)) and found.good.columns == ["a", "b"]


def test_sound_tables_lose_nothing(spark, churn_rows, tmp_path):
    df = spark.createDataFrame(churn_rows, "k long, v string")
    df.write.parquet(f"{tmp_path}/s.parquet")
    df.write.csv(f"{tmp_path}/s.csv", header=True)
    for kind in ("parquet", "csv"):
        found = read_checked(spark, f"{tmp_path}/s.{kind}")
        assert rows(found.good) == rows(df) and found.rejected.count() == 0


@pytest.fixture
def churn_rows():
    return [(i, f"v{i % 3}") for i in range(20)]


def workbook(path, rows, shared=(), styles=(0, 14, 164), custom='[$-409]d\\-mmm "day"'):
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/a.xml"/><Relationship Id="rId2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(shared) + "</sst>")
        fmt = custom.replace('"', "&quot;")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="{fmt}"/></numFmts><cellXfs>' + "".join(f'<xf numFmtId="{s}"/>' for s in styles) + "</cellXfs></styleSheet>")
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>only</t></is></c></row><row r="2"><c r="A2"><v>7</v></c></row></sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    from datetime import datetime

    from dqengine.operators import telling
    from dqengine.sources import workbook as books

    shared = ["<si><t>name</t></si>", "<si><t>when</t></si>", "<si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>", "<si><t>amount</t></si>"]
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>3</v></c><c r="E1" t="s"><v>3</v></c></row>'
    body = '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" s="1"><v>45292.5</v></c><c r="C2"><v>12.5</v></c><c r="E2" t="b"><v>1</v></c></row>'
    body += '<row r="4"><c r="A4" t="inlineStr"><is><t>x</t></is></c><c r="B4" s="2"><v>45293</v></c><c r="C4" t="inlineStr"><is><t>thirty</t></is></c></row><row r="5"/>'
    workbook(tmp_path / "a.xlsx", head + body, shared)
    df = books.read_workbook(spark, str(tmp_path / "a.xlsx"))
    assert df.dtypes == [("name", "string"), ("when", "timestamp"), ("amount", "string"), ("column_4", "string"), ("amount_", "boolean")]
    assert rows(df) == [("rich", datetime(2024, 1, 1, 12), "12.5", None, True), ("x", datetime(2024, 1, 2), "thirty", None, None)]
    kinds = {(r.place, r.kind): r.n for r in books.cell_kinds(books.read_rows(spark, str(tmp_path / "a.xlsx")).where("sheet = 'One'")).collect()}
    assert kinds == {(0, "text"): 2, (1, "date"): 2, (2, "number"): 1, (2, "text"): 1, (4, "boolean"): 1}
    found = telling.samples(df.selectExpr("name", "amount"), "name")
    assert {r["row"]["amount"] for r in found if r["issue_type"] == "mixed_types"} == {"12.5", "thirty"}
    assert rows(books.read_workbook(spark, str(tmp_path / "a.xlsx"), "Two")) == [(7.0,)]
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    errors = books.read_rows(spark, f"{tmp_path}/*.xlsx").where("error is not null").collect()
    assert [r.file.rsplit("/", 1)[-1] for r in errors] == ["broken.xlsx"] and "BadZipFile" in errors[0].error
    with pytest.raises(tables.UnreadableFile):
        books.read_workbook(spark, str(tmp_path / "broken.xlsx"))
