"""SRC6: spreadsheets (Office Open XML workbooks) as rows, a file a task.

A workbook is a ZIP of XML parts, which Python's own library reads, so workers need no spreadsheet
library. A sheet ends at 1,048,576 rows; its XML is read cell by cell, only its shared strings are held.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import batched
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from .iterated import opened

ROWS = 10_000  # of a batch
#: Namespaces and part names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
WORKBOOK, LINKS, STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
CODED = re.compile("_x([0-9A-Fa-f]{4})_")  # how the format writes what XML can't hold
UNFIT = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def text_of(node: ET.Element) -> str:
    """The text of a string item: its runs without phonetic hints."""
    parts = [t.text or "" for path in (f"{MAIN}t", f"{MAIN}r/{MAIN}t") for t in node.findall(path)]
    return CODED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def place_of(reference: str) -> int:
    """The column of a cell's reference: 0 for A1, 27 for AB7."""
    n = 0
    for c in reference.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def cell_of(cell: ET.Element, strings: list[str]) -> str | None:
    """A cell's value as text: null for empty cells and errors, true or false for truth values."""
    kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        held = cell.find(f"{MAIN}is")
        return None if held is None else text_of(held)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "true" if value.strip() == "1" else "false"
    return CODED.sub(lambda m: chr(int(m[1], 16)), value) if kind == "str" else value


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[dict[int, str]]:
    """``{column: value}`` of each row of the sheet of that name, or of the first."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheets = {s.get("name"): s.get(LINK) for s in ET.fromstring(book.read(WORKBOOK)).iter(f"{MAIN}sheet")}
        if not sheets or sheet not in (None, *sheets):
            raise ValueError(f"no sheet {sheet} in the workbook")
        link = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        target = next(x.get("Target") for x in ET.fromstring(book.read(LINKS)) if x.get("Id") == link)
        strings = [text_of(x) for x in ET.fromstring(book.read(STRINGS)).findall(f"{MAIN}si")] if STRINGS in book.namelist() else []
        with book.open(target[1:] if target.startswith("/") else f"xl/{target}") as part:
            for _, node in ET.iterparse(part):
                if node.tag == f"{MAIN}row":
                    row, at = {}, -1
                    for cell in node.findall(f"{MAIN}c"):
                        at = place_of(cell.get("r")) if cell.get("r") else at + 1
                        if (value := cell_of(cell, strings)) is not None:
                            row[at] = value
                    yield row
                    node.clear()


def excel(spark: SparkSession, path: str, schema: str, sheet: str | None = None) -> DataFrame:
    """The rows below the header of a sheet of each workbook in ``path``, as the columns of ``schema``.

    Columns are found by their header, in any order; of equal headers the first one counts, others
    are left out. Empty cells, errors and values that aren't of the column's type are null, rows
    without any cell are skipped. Dates are the serial numbers that the format holds. A workbook
    without one of the columns or without the sheet raises ValueError; one without rows has none.
    """
    fields = StructType.fromDDL(schema).fields
    names = [f.name for f in fields]
    kind = pa.schema([(f"c{k}", pa.string()) for k in range(len(names))])

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = (row for row in sheet_rows(content, sheet) if row)
                head = next(rows, None)
                if head is None:
                    continue
                places = {value: at for at, value in sorted(head.items(), reverse=True)}
                if missing := [n for n in names if n not in places]:
                    raise ValueError(f"a workbook lacks the columns {', '.join(missing)}")
                for some in batched(rows, ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([row.get(places[n]) for row in some], pa.string()) for n in names], schema=kind)

    cells = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")
    found = cells.mapInArrow(run, ", ".join(f"{c} string" for c in kind.names))

    def typed(name: str, field):
        whole = F.col(name).try_cast(field.dataType)
        if isinstance(field.dataType, IntegralType):  # numbers may be written as 1E5 or 7.0
            whole = F.coalesce(whole, F.col(name).try_cast("double").try_cast(field.dataType))
        return whole.alias(field.name)

    return found.select([typed(c, f) for c, f in zip(kind.names, fields)])


def cell_xml(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    text = UNFIT.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook(names: list[str], rows: list[tuple], sheet: str = "Sheet1") -> bytes:
    """A workbook with one sheet: a header and rows."""
    main, links = MAIN[1:-1], LINK[1:-3]
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{links}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        WORKBOOK: f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        LINKS: f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{links}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{''.join(map(cell_xml, row))}</row>" for row in [tuple(names), *rows]) + "</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, body in parts.items():
            book.writestr(name, HEAD + body)
    return out.getvalue()


def workbooks(df: DataFrame, folder: str, rows: int = 100_000) -> int:
    """``df`` as workbooks of at most ``rows`` rows in ``folder`` (of a store that Arrow opens); how many
    there are. The rows of an attempt that is repeated have the same names, so none counts twice."""
    names = df.columns

    def run(batches):
        from pyspark import TaskContext

        store, place = opened(folder)
        store.create_dir(place, recursive=True)
        cells = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for k, some in enumerate(batched(cells, rows)):
            with store.open_output_stream(f"{place}/part-{TaskContext.get().partitionId():05d}-{k:05d}.xlsx") as out:
                out.write(workbook(names, list(some)))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], ["k"])

    return df.mapInArrow(run, "k long").count()
