"""Delivered tables: headers of CSV, TSV, JSON, Parquet and xlsx files, whole xlsx sheets, Markdown tables, page text."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# Fixed value: what headings of equipment end in.
SCENE = "场景"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def headers(spark: SparkSession, path: str, format_: str) -> list[str]:
    """Column names of a delivered file, trimmed, blank ones left out."""
    if format_ in ("csv", "tsv"):
        names = spark.read.option("header", True).option("sep", "," if format_ == "csv" else "\t").csv(path).columns
    elif format_ == "parquet":
        names = spark.read.parquet(path).columns
    elif format_ == "json":
        # a list of objects, one object, or one object a line
        one = F.when(F.ltrim("value").startswith("["), F.get_json_object("value", "$[0]")).otherwise(F.substring_index(F.ltrim("value"), "\n", 1))
        whole = F.coalesce(F.json_object_keys(one), F.json_object_keys("value"))
        row = spark.read.text(path, wholetext=True).where(F.trim("value") != "").select(whole.alias("k")).first()
        names = list(row["k"] or []) if row is not None else []
    elif format_ == "xlsx":
        rows = cells(spark, path).where("sheet_no = 0 and row = 1").orderBy("col").collect()  # one header row
        names = [r["value"] or "" for r in rows]
    else:
        raise ValueError(f"files of format {format_} cannot be read here")
    return [n for n in (str(x).lstrip("﻿").strip() for x in names) if n]


def digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, sha256, size) of whole files."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def workbook(content: bytes) -> Iterator[tuple[int, str, int, int, str | None]]:
    """(sheet number, sheet name, row, column, value) of the filled cells of an xlsx file; rows and columns from 1.

    Whole numbers lose their `.0`, booleans read true or false, shared and inline texts are joined from their runs.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        parts = set(archive.namelist())
        shared = []
        if "xl/sharedStrings.xml" in parts:
            for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(_SHEET + "t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(_SHEET + "sheet")
        for number, sheet in enumerate(sheets):
            target = targets[sheet.get(_REL)].lstrip("/")
            root = ElementTree.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}"))
            for row_no, row in enumerate(root.iter(_SHEET + "row"), 1):
                for col_no, cell in enumerate(row.iter(_SHEET + "c"), 1):
                    letters = re.match(r"[A-Z]+", cell.get("r") or "")
                    column = _column(letters[0]) if letters else col_no
                    value, kind = cell.find(_SHEET + "v"), cell.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(_SHEET + "t"))
                    elif value is None or value.text is None:
                        continue
                    elif kind == "s":
                        text = shared[int(value.text)]
                    elif kind == "b":
                        text = "true" if value.text == "1" else "false"
                    elif kind in (None, "n"):
                        number_ = float(value.text)
                        text = str(int(number_)) if number_.is_integer() else repr(number_)
                    else:
                        text = value.text
                    if text != "":
                        yield number, sheet.get("name"), int(row.get("r") or row_no), column, text


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def cells(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, sheet_no, sheet, row, col, value) of xlsx files, one file a task at most."""
    return cells_of(spark.read.format("binaryFile").load(list(paths)).select("path", "content"))


def cells_of(files: DataFrame) -> DataFrame:
    """cells() of files (path, content)."""
    names = ["path", "sheet_no", "sheet", "row", "col", "value"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(path, *cell) for cell in workbook(content)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)

    return files.mapInArrow(run, "path string, sheet_no int, sheet string, row int, col int, value string")


def sheet_rows(cells_: DataFrame, columns: list[str], first_row: int = 2) -> DataFrame:
    """(path, sheet, row, the columns) of cells by position; rows before first_row are headings."""
    picked = [F.max(F.when(F.col("col") == k, F.trim("value"))).alias(name) for k, name in enumerate(columns, 1)]
    return cells_.where(F.col("row") >= first_row).groupBy("path", "sheet", "row").agg(*picked)


def features(rows: DataFrame, key: str = "feature_code") -> DataFrame:
    """Feature rows with their key, blank texts as null."""
    cleaned = [F.when(F.col(c) == "", None).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    return rows.select(*cleaned).where(F.col(key).isNotNull())


def _clean(cell: str) -> str:
    return " ".join(re.sub(r"(?i)<br\s*/?>", " ", cell).replace("**", "").split())


def _snake(text: str) -> str:
    return re.sub(r"[^\w]+", "_", text.strip().lower()).strip("_")


def _cells(line: str) -> list[str]:
    return [_clean(c) for c in line.strip().strip("|").split("|")]


def markdown_tables(text: str, suffix: str = SCENE) -> Iterator[tuple[int, list[str], list[list[str]]]]:
    """(number, columns, rows) of each pipe table; equipment is the `##` heading above it, phase the `###` one.

    A first body row that only names groups' parts is joined to the header above it; equal names get _1, _2; rows and
    columns without any text are left out.
    """
    equipment = phase = ""
    lines, at, number = text.splitlines(), 0, 0
    while at < len(lines):
        line = lines[at].strip()
        if line.startswith("## "):
            equipment, phase = line[3:].strip().removesuffix(suffix).strip(), ""
        elif line.startswith("### "):
            phase = line[4:].strip()
        elif line.startswith("|") and at + 1 < len(lines) and re.fullmatch(r"\|?[\s:|\-]*-[\s:|\-]*\|?", lines[at + 1].strip()):
            head, body = _cells(line), []
            at += 2
            while at < len(lines) and lines[at].strip().startswith("|"):
                body.append(_cells(lines[at]))
                at += 1
            yield number, *_table(head, body, equipment, phase)
            number += 1
            continue
        at += 1


def _table(head: list[str], body: list[list[str]], equipment: str, phase: str) -> tuple[list[str], list[list[str]]]:
    wide = len(head)
    body = [(r + [""] * wide)[:wide] for r in body]
    grouped = any(not h for h in head)
    if grouped and body:
        group, names = "", []
        for h, sub in zip(head, body[0], strict=True):
            group = h or group
            names.append(f"{_snake(group)}__{_snake(sub)}" if sub else _snake(group))
        body = body[1:]
    else:
        names = [_snake(h) for h in head]
    seen: dict[str, int] = {}
    unique = []
    for n in names:
        n = n or "column"
        unique.append(n if n not in seen else f"{n}_{seen[n]}")
        seen[n] = seen.get(n, 0) + 1
    body = [r for r in body if any(r)]
    keep = [k for k in range(wide) if any(r[k] for r in body)]
    return ["equipment", "phase", *(unique[k] for k in keep)], [[equipment, phase, *(r[k] for k in keep)] for r in body]


@F.udtf(returnType="table_no: int, row_no: int, cells: map<string,string>")
class MarkdownTables:
    """SELECT * FROM t, LATERAL markdown_tables(text)."""

    def eval(self, text: str):
        for number, columns, rows in markdown_tables(text or ""):
            for k, row in enumerate(rows):
                yield number, k, dict(zip(columns, row, strict=True))


class _Text(HTMLParser):
    SKIPPED = frozenset(("script", "style", "svg", "noscript"))

    def __init__(self, least: int) -> None:
        super().__init__(convert_charrefs=True)
        self.least, self.depth, self.parts = least, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIPPED

    def handle_endtag(self, tag):
        self.depth -= tag in self.SKIPPED and self.depth > 0

    def handle_data(self, data):
        text = " ".join(data.split())
        if not self.depth and len(text) >= self.least:
            self.parts.append(text)


def page_text(page: str | None, most: int = 6000, least: int = 20) -> str:
    """Text nodes of `least` characters or more, one a line, cut to `most`; the cut is what the reader of pages asks for."""
    reader = _Text(least)
    reader.feed(page or "")
    reader.close()
    return "\n".join(reader.parts)[:most]


def page_texts(pages: DataFrame, most: int = 6000, least: int = 20) -> DataFrame:
    """(page_id, url, status, sha256, text) of pages; status is ok or empty."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("html").to_pylist()
            texts = [page_text(x, most, least) for x in raw]
            hashes = [hashlib.sha256((x or "").encode()).hexdigest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(["ok" if t else "empty" for t in texts]), pa.array(hashes), pa.array(texts, pa.string())], names=["page_id", "url", "status", "sha256", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, status string, sha256 string, text string")


def profiles(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, rows, equipment, phase) of CSV files with a header: row count and the first equipment and phase in the file's order.

    Large files may be read in pieces by several tasks: rows are ordered by the place of their piece, then within it.
    """
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(list(paths))
    rows = rows.withColumns({"path": F.input_file_name(), "_at": F.struct(F.input_file_block_start(), F.monotonically_increasing_id())})
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("equipment", "phase")]
    return rows.groupBy("path").agg(F.count("*").alias("rows"), *first)


def register(spark: SparkSession) -> None:
    spark.udtf.register("markdown_tables", MarkdownTables)
