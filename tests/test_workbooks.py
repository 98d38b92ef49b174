"""Workbooks made here, by hand, against what they hold and against CSV."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from undula.sources import tables, workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(k):
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def make(path, rows, shared=True, sheets=("Data",), gaps=False):
    """A workbook; strings go to the shared ones, or stand in their cells. gaps: empty cells aren't written."""
    strings = []

    def cell(r, k, v):
        at = f'r="{letters(k)}{r}"'
        if v is None:
            return "" if gaps else f"<c {at}/>"
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if not isinstance(v, str):
            return f"<c {at}><v>{v!r}</v></c>"
        if v.startswith("#"):
            return f'<c {at} t="e"><v>{v}</v></c>'
        if shared:
            strings.append(v)
            return f'<c {at} t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c {at} t="inlineStr"><is><r><t>{escape(v[:1])}</t></r><r><t>{escape(v[1:])}</t></r></is></c>'

    body = "".join(f'<row r="{r}">{"".join(cell(r, k, v) for k, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k == 1 else ""}worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k in range(1, len(sheets) + 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {MAIN}><sheetData>{body if k == len(sheets) else ''}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f'<si><t xml:space="preserve">{escape(v)}</t><rPh><t>not this</t></rPh></si>' for v in strings) + "</sst>")
    return str(path)


HEAD = ["Time", "XMEAS(1)", *(f"c{k}" for k in range(30))]


@pytest.mark.parametrize("shared", [True, False])
@pytest.mark.parametrize("gaps", [True, False])
def test_cells(tmp_path, shared, gaps):
    rows = [["a & b", "é漢", None, 1.5, -2e-7, True], [], ["x" * 40_000, None, "#DIV/0!", 7], [None, None], *[[k, str(k)] for k in range(2500)]]
    content = open(make(tmp_path / "a.xlsx", rows, shared, gaps=gaps), "rb").read()
    got = dict(workbooks.rows_of(content))
    assert got[1] == ["a & b", "é漢", None, "1.5", "-2e-07", "1"] and 2 not in got and 4 not in got
    assert got[3] == ["x" * 40_000, None, None, "7"] and got[5] == ["0", "0"] and len(got) == 2502
    assert [workbooks.column_of(x) for x in ("A1", "Z9", "AA1", "BC12")] == [0, 25, 26, 54]


def test_many_workbooks_are_the_csvs(spark, tmp_path):
    paths = []
    for run in (1, 2):
        rows = [[t / 2, t * 1.25 + run, *(None if (t + k) % 7 == 0 else float(k * t) for k in range(30))] for t in range(1200)]
        paths.append(make(tmp_path / f"mode1_3_{run}.xlsx", [HEAD, *rows], gaps=run == 1))
        text = "\n".join(",".join("" if v is None else repr(v) for v in r) for r in rows)
        (tmp_path / f"mode1_3_{run}.csv").write_text(",".join(HEAD) + "\n" + text + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert workbooks.sheet_rows(spark, paths).rdd.getNumPartitions() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    both = tables.process_runs(spark, paths)
    for run in (1, 2):
        csv = tables.process_run(spark, str(tmp_path / f"mode1_3_{run}.csv"), 3, run)
        one = tables.process_run(spark, str(tmp_path / f"mode1_3_{run}.xlsx"), 3, run)
        assert one.columns == csv.columns and sorted(both.columns) == sorted(csv.columns)
        want = sorted(map(str, csv.select(*(csv[c].cast("double") for c in csv.columns)).collect()))
        for got in (one, both.where(f"simulation_run = {run}").select(*csv.columns)):
            assert sorted(map(str, got.select(*(got[c].cast("double") for c in csv.columns)).collect())) == want and len(want) == 1200
    with pytest.raises(ValueError, match="doesn't name"):
        tables.process_runs(spark, [str(tmp_path / "other.xlsx")])


def test_sheets_strings_and_faults(spark, tmp_path):
    path = make(tmp_path / "b.xlsx", [["name", "n"], ["one", 1], ["two", None]], sheets=("Empty", "Data"))
    got = workbooks.workbooks(spark, [path], "Data", ["name"])
    assert [(r.name, r.n) for r in got.orderBy("name").collect()] == [("one", 1.0), ("two", None)] and got.first().path.endswith("b.xlsx")
    with pytest.raises(ValueError, match="none of the workbooks"):
        workbooks.workbooks(spark, [path])
    with pytest.raises(Exception, match="no sheet 'Other'"):
        workbooks.workbooks(spark, [path], "Other")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        workbooks.workbooks(spark, [path], "Data").collect()
    with pytest.raises(ValueError, match="no columns z"):
        workbooks.workbooks(spark, [path], "Data", ["z"])
    other = make(tmp_path / "c.xlsx", [["name", "m"], ["x", 1]], sheets=("Empty", "Data"))
    with pytest.raises(ValueError, match="headers differ"):
        workbooks.workbooks(spark, [path, other], "Data")
    with pytest.raises(ValueError, match="repeat"):
        workbooks.workbooks(spark, [make(tmp_path / "d.xlsx", [["a", "A"], [1, 2]])])
    (tmp_path / "e.xlsx").write_bytes(workbooks.POINTER_START + b"v1")
    with pytest.raises(Exception, match="large-file storage"):
        workbooks.workbooks(spark, [str(tmp_path / "e.xlsx")])
