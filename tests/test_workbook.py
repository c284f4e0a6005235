"""Workbooks written by hand: every kind of cell, missing ones, dates, two files."""

import datetime
import zipfile

import pytest

from granary.schemas import RAW_SALES
from granary.sources.sales import sales_workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, rows, shared, sheet="Year 2010-2011", flags=""):
    """A workbook with an empty first sheet and ``rows`` (XML of their cells) in the second."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><workbookPr {flags}/><sheets><sheet name="Year 2009-2010" sheetId="1" r:id="rId1"/><sheet name="{sheet}" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {MAIN}><sheetData>{''.join(f'<row r="{i}">{r}</row>' for i, r in enumerate(rows, 1))}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si>{s}</si>' for s in shared)}</sst>")


SHARED = [f"<t>{n}</t>" for n in RAW_SALES.names] + ["<t>85123A</t>", "<r><t>WHITE </t></r><r><rPr/><t>&amp; RED</t></r><rPh><t>no</t></rPh>", "<t>C536379</t>", '<t xml:space="preserve"> 12 </t>']
HEADER = "".join(f'<c r="{"ABCDEFGH"[i]}1" t="s"><v>{i}</v></c>' for i in range(8))


def test_cells(spark, tmp_path):
    rows = [
        HEADER,
        '<c r="A2"><v>536365</v></c><c r="B2" t="s"><v>8</v></c><c r="C2" t="s"><v>9</v></c><c r="D2"><v>6</v></c><c r="E2" s="1"><v>40513.351388888892</v></c><c r="F2"><v>2.5499999999999998</v></c><c r="G2"><v>17850</v></c><c r="H2" t="inlineStr"><is><t>United Kingdom</t></is></c>',
        '<c r="A3" t="s"><v>10</v></c><c r="D3" t="s"><v>11</v></c><c r="E3" t="d"><v>2010-12-01T09:00:00</v></c><c r="F3" t="e"><v>#N/A</v></c><c r="G3"/><c r="H3" t="str"><v>Norway</v></c>',
        "",
        '<c><v>1</v></c><c t="b"><v>1</v></c><c/><c><v>1.5</v></c><c><v>1</v></c><c t="s"><v>8</v></c>',
    ]
    workbook(f"{tmp_path}/sales.xlsx", rows, SHARED)
    got = sales_workbook(spark, f"{tmp_path}/sales.xlsx")
    assert got.schema == RAW_SALES
    assert [tuple(r) for r in got.collect()] == [
        ("536365", "85123A", "WHITE & RED", 6, datetime.datetime(2010, 12, 1, 8, 26), 2.55, 17850.0, "United Kingdom"),
        ("C536379", None, None, 12, datetime.datetime(2010, 12, 1, 9, 0), None, None, "Norway"),
        ("1", "TRUE", None, None, datetime.datetime(1900, 1, 1), None, None, None),
    ]


def test_many_workbooks_and_errors(spark, tmp_path):
    body = [HEADER, *(f'<c r="A{i}"><v>{i}</v></c><c r="E{i}"><v>{i}.5</v></c>' for i in range(2, 12_002))]
    for k in range(2):
        workbook(f"{tmp_path}/part{k}.xlsx", body, SHARED, flags='date1904="1"' if k else "")
    got = sales_workbook(spark, f"{tmp_path}/part*.xlsx")
    assert got.count() == 24_000 and got.select("Invoice").distinct().count() == 12_000
    assert {r.InvoiceDate for r in got.where("Invoice = '100'").collect()} == {datetime.datetime(1900, 4, 9, 12), datetime.datetime(1904, 4, 10, 12)}
    with pytest.raises(Exception, match="no sheet 'Else'"):
        sales_workbook(spark, f"{tmp_path}/part0.xlsx", "Else").collect()
    workbook(f"{tmp_path}/bare.xlsx", ['<c r="A1" t="s"><v>0</v></c>'], SHARED)
    with pytest.raises(Exception, match="no columns StockCode"):
        sales_workbook(spark, f"{tmp_path}/bare.xlsx").collect()
