"""Spreadsheet workbooks (.xlsx), each file read by one task: rows with the type of every cell beside its value."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.sources.tables import UnreadableFile

# Numbers of built-in formats that show a number as a date or time: fixed by the file format.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
BATCH = 5_000
"""Rows that a task holds."""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _parts(book: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    """Elements of one kind of a part, each dropped once it has been read."""
    if name not in book.namelist():
        return
    with book.open(name) as part:
        for _, element in ElementTree.iterparse(part):
            if _local(element.tag) == wanted:
                yield element
                element.clear()


def _said(element: ElementTree.Element) -> str:
    """The text of a cell or shared string, without phonetic readings."""
    return "".join(t.text or "" for run in element for t in ([run] if _local(run.tag) == "t" else run if _local(run.tag) == "r" else []) if _local(t.tag) == "t")


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows dates."""
    own = {e.get("numFmtId"): re.sub(r'"[^"]*"|\[[^\]]*\]|\\\\.', "", e.get("formatCode", "")) for e in _parts(book, "xl/styles.xml", "numFmt")}
    return [
        int(x.get("numFmtId", 0)) in DATE_FORMATS or bool(re.search("[dmyhs]", own.get(x.get("numFmtId"), "").lower()))
        for styles in _parts(book, "xl/styles.xml", "cellXfs")
        for x in styles
    ]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet in order."""
    targets = {e.get("Id"): e.get("Target") for e in _parts(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    found = []
    for e in _parts(book, "xl/workbook.xml", "sheet"):
        target = targets.get(next((v for k, v in e.attrib.items() if _local(k) == "id"), None), "")
        found.append((e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def rows_of(content: bytes) -> Iterator[tuple[str, int, list, list]]:
    """(sheet, row, values, kinds); kinds are number, text, boolean, date and error, None where a cell is empty."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = [_said(e) for e in _parts(book, "xl/sharedStrings.xml", "si")]
    dates = _date_styles(book)
    epoch = datetime(1904, 1, 1) if any(e.get("date1904") in ("1", "true") for e in _parts(book, "xl/workbook.xml", "workbookPr")) else datetime(1899, 12, 30)

    def cell(e: ElementTree.Element) -> tuple[str | None, str | None]:
        kind, style = e.get("t", "n"), int(e.get("s", 0))
        inline = next((x for x in e if _local(x.tag) == "is"), None)
        value = next((x.text for x in e if _local(x.tag) == "v"), None)
        if kind == "inlineStr":
            return (_said(inline) if inline is not None else ""), "text"
        if value is None:
            return None, None
        if kind == "s":
            return shared[int(value)], "text"
        if kind == "b":
            return ("true" if value == "1" else "false"), "boolean"
        if kind != "n":
            return value, {"e": "error", "d": "date"}.get(kind, "text")
        if style < len(dates) and dates[style]:
            return (epoch + timedelta(seconds=round(float(value) * 86400))).isoformat(sep=" "), "date"
        return value, "number"

    for name, part in _sheets(book):
        at = 0
        for row in _parts(book, part, "row"):
            at = int(row.get("r", at + 1))
            values, kinds = [], []
            for e in row:
                place = _column(e.get("r", "")) if e.get("r") else len(values)
                values += [None] * (place + 1 - len(values))
                kinds += [None] * (place + 1 - len(kinds))
                values[place], kinds[place] = cell(e)
            yield name, at, values, kinds


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row (from 1), values, kinds and error of every row of the workbooks at a path, which Spark lists and deals out. A
    workbook that can't be read gives what could be read of it and a row with the error; an empty one gives none."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    texts = T.ArrayType(T.StringType())
    schema = T.StructType().add("file", "string").add("sheet", "string").add("row", "long").add("values", texts).add("kinds", texts).add("error", "string")
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held: list[tuple] = []
                try:
                    for sheet, row, values, kinds in rows_of(content.as_py()):
                        held.append((file, sheet, row, values, kinds, None))
                        if len(held) == BATCH:
                            yield made(held)
                            held = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as error:
                    held.append((file, None, None, None, None, f"{type(error).__name__}: {error}"))
                if held:
                    yield made(held)

    return files.mapInArrow(run, schema)


def cell_kinds(rows: DataFrame) -> DataFrame:
    """place (of the column, from 0), kind, n: how many cells below the header are of each type; a column is mixed if it has several."""
    cells = rows.where("row > 1 and kinds is not null").select(F.posexplode("kinds").alias("place", "kind")).where("kind is not null")
    return cells.groupBy("place", "kind").agg(F.count(F.lit(1)).alias("n"))


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet (the first, if None) as a table: its first row names the columns, columns of numbers, truth values or dates alone get
    that type, mixed ones are texts. Short rows end in nulls, rows without a cell are left out."""
    rows = read_rows(spark, path)
    top = rows.where("row = 1").orderBy("file") if sheet is None else rows.where((F.col("row") == 1) & (F.col("sheet") == sheet)).orderBy("file")
    first = top.first()
    if first is None:
        error = rows.where("error is not null").select("error").first()
        raise UnreadableFile(error.error if error else f"no sheet {sheet or ''} with a first row in {path}")
    rows = rows.where(F.col("sheet") == first.sheet)
    kinds: dict[int, set] = {}
    for r in cell_kinds(rows).collect():  # a few for each column
        kinds.setdefault(r.place, set()).add(r.kind)
    cast = {"number": "double", "boolean": "boolean", "date": "timestamp"}
    columns, used = [], set()
    for i, name in enumerate(first["values"]):
        name = (name or "").strip() or f"column_{i + 1}"
        while name in used:
            name += "_"
        used.add(name)
        own = kinds.get(i, set())
        value = F.get("values", F.lit(i))
        columns.append((value.cast(cast[next(iter(own))]) if len(own) == 1 and own <= set(cast) else value).alias(name))
    return rows.where((F.col("row") > 1) & F.exists("kinds", lambda k: k.isNotNull())).select(*columns)
