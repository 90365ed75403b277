"""Workbook cells as shown, and requests answered from keyed state."""

import io
import json
import zipfile

import pytest

from matforge.sources import grids
from matforge.sources.formats import formatted
from matforge.streaming import requests

SHOWN = [
    (1234.5, "General", "1234.5"), (1e10, "General", "10000000000"), (0.1, "General", "0.1"), (1 / 3, "General", "0.333333333"), (-7, "General", "-7"),
    (1234567.891, "#,##0.00", "1,234,567.89"), (1234567.891, "#,##0", "1,234,568"), (0.256, "0%", "26%"), (0.2567, "0.00%", "25.67%"), (5, "000", "005"),
    (-1234.5, "#,##0.00;(#,##0.00)", "(1,234.50)"), (-12, "0", "-12"), (-0.001, "0.00", "0.00"), (1234.5, "0.00E+00", "1.23E+03"), (12.5, '0.0" kg"', "12.5 kg"),
    (1250, '[$\u20b9-4009]#,##0', "\u20b91,250"), (99.5, '"Rs. "0.00', "Rs. 99.50"), (0, "0;-0;\\-", "-"), (3.10, "0.##", "3.1"), (2.5, "0", "3"), (0.5, "#.00", ".50"), (7, "@", "7"),
    (45292, "m/d/yy", "1/1/24"), (45292, "yyyy-mm-dd", "2024-01-01"), (45292.75, "d-mmm-yy h:mm", "1-Jan-24 18:00"), (45292.75, "h:mm AM/PM", "6:00 PM"), (45322.5, "dd/mm/yyyy", "31/01/2024"),
    (0.5208449074, "hh:mm:ss", "12:30:01"), (1, "yyyy-mm-dd", "1900-01-01"), (45292, "dddd, mmmm d", "Monday, January 1"), (1500000, "0.0,,", "1.5"),
]


@pytest.mark.parametrize("value,code,shown", SHOWN)
def test_numbers_are_shown(value, code, shown):
    assert formatted(value, code) == shown


def test_a_formatted_workbook(spark, tmp_path):
    sheet = (
        '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>MATNR</t></is></c><c r="B1" t="inlineStr"><is><t>MAKTX</t></is></c><c r="C1" t="inlineStr"><is><t>Qty</t></is></c><c r="D1" t="inlineStr"><is><t>Since</t></is></c></row>'
        '<row r="2"><c r="A2"><v>1007</v></c><c r="B2" t="inlineStr"><is><t>HEX NUT M12 SS304</t></is></c><c r="C2" s="1"><v>1250.5</v></c><c r="D2" s="2"><v>45292</v></c></row>'
        '<row r="3"><c r="A3"><v>1008</v></c><c r="B3" t="str"><v>HEX NUT M16 SS304</v></c><c r="C3" s="3"><v>0.125</v></c><c r="E3" t="b"><v>1</v></c></row></sheetData></worksheet>'
    )
    styles = '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellStyleXfs><xf numFmtId="9"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="4"/><xf numFmtId="164"/><xf numFmtId="10"/></cellXfs></styleSheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        book.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="A" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", sheet)
        book.writestr("xl/styles.xml", styles)
    (tmp_path / "list.xlsx").write_bytes(data.getvalue())
    rows = [r["cells"] for r in grids.read_grids(spark, str(tmp_path)).orderBy("row_idx").collect()]
    assert rows == [["MATNR", "MAKTX", "Qty", "Since"], ["1007", "HEX NUT M12 SS304", "1,250.50", "2024-01-01"], ["1008", "HEX NUT M16 SS304", "12.50%", "", "TRUE"]]


SCHEMA = "request_id string, place long, method string, body string"


def test_whole_requests_are_refused(spark):
    body = lambda **x: json.dumps(x)
    asked = [
        ("GET", body(cpseId="ONGC", nmcCode="NMC-1"), 405, "method"), (None, "{}", 405, "method"), ("POST", "x" * (256 * 1024 + 1), 413, "too large"), ("POST", "{", 400, "no JSON"), ("POST", None, 400, "no JSON"),
        ("POST", "[1]", 400, "no object"), ("POST", body(nmcCode="NMC-1"), 400, "organisation"), ("POST", body(cpseId=7, nmcCode="NMC-1"), 400, "organisation"), ("POST", body(cpseId="x" * 41, nmcCode="A"), 400, "organisation"),
        ("POST", body(cpseId="ONGC"), 400, "no codes"), ("POST", body(cpseId="ONGC", nmcCodes=[]), 400, "no codes"), ("POST", body(cpseId="ONGC", nmcCodes=["N"] * 501), 400, "too many codes"),
        ("POST", body(cpseId="ONGC", nmcCodes=["N", "-bad"]), 400, "code"), ("POST", body(cpseId="ONGC", nmcCodes=["N", 5]), 400, "code"), ("POST", body(cpseId="COAL INDIA", nmcCodes=["N-1/2", "M", "M"]), 200, None), ("POST", body(cpseId="ONGC", nmcCodes=["N"] * 500), 200, None),
    ]
    rows = spark.createDataFrame([(str(k), k, m, b) for k, (m, b, _, _) in enumerate(asked)], SCHEMA)
    got = {int(r["request_id"]): r for r in requests.checked(rows).collect()}
    assert [(got[k]["status"], got[k]["problem"]) for k in range(len(asked))] == [(s, p) for _, _, s, p in asked]
    assert got[14]["codes"] == ["N-1/2", "M"] and got[12]["codes"] is None


def test_requests_are_answered_as_of_arrival(spark, tmp_path):
    source, sink, home = (str(tmp_path / n) for n in ("in", "out", "check"))

    def arrive(rows):
        spark.createDataFrame([(r, p, "POST", json.dumps(b)) for r, p, b in rows], SCHEMA).write.mode("append").json(source)
        stream = requests.answers(spark.readStream.schema(SCHEMA).json(source))
        stream.writeStream.format("json").option("path", sink).option("checkpointLocation", home).outputMode("append").trigger(availableNow=True).start().awaitTermination(240)

    writers = [(f"r{k:02d}", k, {"cpseId": f"ORG {k:02d}", "nmcCode": "NMC-A"}) for k in range(12)]
    arrive([*writers, ("bad", 5, {"cpseId": "ORG 99", "nmcCodes": ["NMC-A", "?"]})])
    arrive([("again", 1, {"cpseId": "ORG 03", "nmcCodes": ["NMC-A", "NMC-B"]}), ("last", 2, {"cpseId": "ORG 77", "nmcCode": "NMC-B"})])
    got = {(r["request_id"], r["nmc_code"]): r for r in spark.read.schema(requests.ANSWERS).json(sink).collect()}
    assert len(got) == 15
    for k in range(12):
        assert got[f"r{k:02d}", "NMC-A"]["others"] == "|".join(f"ORG {j:02d}" for j in range(k)) and got[f"r{k:02d}", "NMC-A"]["published"]
    assert got["again", "NMC-A"]["others"].count("|") == 10 and not got["again", "NMC-A"]["published"], "all twelve writers are kept, the refused one is not"
    assert got["again", "NMC-B"]["others"] == "" and got["last", "NMC-B"]["others"] == "ORG 03"
