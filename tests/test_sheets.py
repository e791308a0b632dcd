"""SRC6: workbooks with the forms of cells that spreadsheet programs write."""

import io
import zipfile

import pytest
from pyspark.errors import PythonException

from scriptorium.sources import sheets

SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="B1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>score</t></is></c><c r="AB1" t="s"><v>1</v></c><c r="AC1" t="s"><v>0</v></c></row>
<row r="3"><c r="B3" t="s"><v>2</v></c><c r="C3"><v>1E3</v></c><c r="AB3" t="b"><v>1</v></c><c r="AC3"><v>9</v></c></row>
<row r="4"/>
<row r="5"><c r="B5" t="str"><f>A1</f><v>a_x0009_b</v></c><c r="C5" t="e"><v>#DIV/0!</v></c></row>
<row r="6"><c r="C6" t="inlineStr"><is><t>none</t></is></c><c r="AB6" t="b"><v>0</v></c></row></sheetData></worksheet>"""
STRINGS = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>word</t></si><si><t>known</t></si>
<si><r><t xml:space="preserve">two </t></r><r><t>parts</t></r><rPh sb="0" eb="1"><t>hint</t></rPh></si></sst>"""


def with_parts(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(sheets.workbook(["x"], []))) as a, zipfile.ZipFile(out, "w") as b:
        for name in a.namelist():
            b.writestr(name, parts.pop(name, None) or a.read(name))
        for name, body in parts.items():
            b.writestr(name, body)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "one.xlsx").write_bytes(with_parts(**{"xl/worksheets/sheet1.xml": SHEET, "xl/sharedStrings.xml": STRINGS}))
    return str(tmp_path)


def test_cells_of_all_kinds(spark, folder):
    rows = sheets.excel(spark, folder, "known boolean, word string, score int").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(True, "two parts", 1000), (None, "a\tb", None), (False, None, None)], key=str)


def test_a_sheet_by_name_and_what_is_missing(spark, folder):
    assert sheets.excel(spark, folder, "word string", "Sheet1").count() == 3
    for schema, sheet in (("word string", "other"), ("word string, absent int", None)):
        with pytest.raises(PythonException, match="ValueError"):
            sheets.excel(spark, folder, schema, sheet).collect()


def test_round_trip_of_odd_values(spark, tmp_path):
    rows = [(1, "a\r\nb\x00 _x0041_ <&>\" ", 0.1 + 0.2, True), (None, None, None, None), (-(2**53), "", 1e-300, False), (7, "🙂 é", -0.0, None)]
    df = spark.createDataFrame(rows, "id long, `a <b> & c` string, x double, t boolean").repartition(2)
    assert sheets.workbooks(df, f"file://{tmp_path}/w", rows=1) == 4
    back = sheets.excel(spark, f"file://{tmp_path}/w", "id long, `a <b> & c` string, x double, t boolean").collect()
    assert sorted(map(tuple, back), key=str) == sorted([r for r in rows if r != (None,) * 4], key=str)


def test_no_rows(spark, tmp_path):
    (tmp_path / "empty.xlsx").write_bytes(sheets.workbook(["id"], []))
    assert sheets.excel(spark, str(tmp_path), "id long").count() == 0
