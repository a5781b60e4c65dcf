import io
import json
import zipfile

import pytest

from pagewright.plans import flow
from pagewright.sources import files, office, web

WNS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SNS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda t, s="": f'<w:p><w:pPr>{s}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Top", '<w:pStyle w:val="Heading1"/>') + p("plain") + p("item", "<w:numPr/>") + f"<w:tbl><w:tr>{cell('a|b')}{cell('c')}</w:tr><w:tr>{cell('1')}</w:tr></w:tbl>"
    return packed({"word/document.xml": f"<w:document {WNS}><w:body>{body}</w:body></w:document>"})


def xlsx():
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x\ny</t></is></c></row><row r="3"><c r="B3"><v>2.5</v></c><c r="C3" t="b"><v>1</v></c></row>'
    return packed({
        "xl/workbook.xml": f'<workbook {SNS}><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {SNS}><si><t>he</t><t>ad</t></si></sst>", "xl/worksheets/s.xml": f"<worksheet {SNS}><sheetData>{rows}</sheetData></worksheet>",
    })


@pytest.mark.parametrize(
    "path, data, want",
    [
        ("a.docx", docx(), "# Top\n\nplain\n\n- item\n\n| a\\|b | c |\n| --- | --- |\n| 1 |  |"),
        ("a.XLSX", xlsx(), "## One\n\n| head |  | x<br>y |\n| --- | --- | --- |\n|  | 2.5 | TRUE |"),
        ("a.srt", b"1\r\n00:01 --> 00:02\r\n<i>Hi</i>\r\nthere\r\n\r\n2\r\n00:02 --> 00:03\r\nHi there\r\n", "Hi there"),
        ("a.csv", b"a;b\n1;2\n", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        ("a.txt", "中文".encode("gb18030"), "中文"),
        ("a.txt", b"\xff\xfea\x00", "a"),
        ("a.ipynb", json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": "1", "outputs": [{"text": ["2\n"]}]}]}).encode(), "# T\n\n```python\n1\n```\n\n```\n2\n```"),
        ("a.rss", b"<rss><channel><item><title>T</title><link>u</link><description>&lt;p&gt;d&lt;/p&gt;</description></item></channel></rss>", "## [T](u)\n\nd"),
        ("a.zip", packed({"b.txt": "x", "c.bin": "y", "d.zip": packed({"e.txt": "deep", "f.zip": packed({"g.txt": "no"})})}), "# b.txt\n\nx\n\n# d.zip\n\n# e.txt\n\ndeep"),
        ("a.html", b"<title>t</title><h1>H</h1><p>a<br>b</p><ul><li>x</li></ul><table><tr><td>1</td><td>2</td></tr></table><script>no</script>", "# H\n\na\nb\n\n- x\n\n| 1 | 2 |"),
    ],
)
def test_readers(path, data, want):
    md, status, message = office.convert(path, data)
    assert (status, message) == (None, None) and md == want


def test_statuses():
    assert office.convert("a.docx", b"junk")[1] == "E_MARKITDOWN"
    assert office.convert("a.docx", b"\xd0\xcf\x11\xe0junk")[1] == "E_ENCRYPTED"
    assert office.convert("a.xyz", b"")[1] == "E_UNSUPPORTED_FORMAT" and office.convert("a.txt", None)[1] == "E_FILE_NOT_FOUND"


def test_folder(spark, tmp_path):
    for name, data in {"a.docx": docx(), "b.xlsx": xlsx(), "c.md": b"x", "d": b"x", "e.xyz": b"x", "sub/f.txt": b"deep", "g.docx": b"broken", "h.state.json": b"{}"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in files.listed(spark, str(tmp_path)).collect()}
    assert reasons == {"a.docx": None, "b.xlsx": None, "c.md": "markdown already", "d": "no extension", "e.xyz": "unsupported extension .xyz", "f.txt": None, "g.docx": None, "h.state.json": "artifact"}
    out = {r.path.rsplit("/", 1)[1]: r for r in flow.convert_folder(spark, str(tmp_path)).collect()}
    assert out["a.docx"].md.startswith("# Top") and out["f.txt"].output == "out/f.md" and out["g.docx"].status == "E_MARKITDOWN" and len(out) == 4
    cells = office.table_cells(files.contents(spark, str(tmp_path))).collect()
    assert {(r.row, r.col, r.text) for r in cells} == {(0, 0, "head"), (0, 2, "x\ny"), (2, 1, "2.5"), (2, 2, "TRUE")}


def test_html_reader_never_fails(spark):
    df = spark.createDataFrame([(1, None), (2, "<p><b>x<table><tr><td>"), (3, "&amp;&copy;<a href=u>t</a>")], "page_id long, html string")
    out = {r.page_id: r for r in web.html_text(df).collect()}
    assert out[1].text == "" and out[3].text == "&©t" and out[3].links[0].href == "u"
