"""Office files, notebooks, subtitles and archives as Markdown, with the standard library alone.

The readers are plain functions of bytes; converted() maps them over a frame of
(path, content). A file that cannot be read gives a status and no failed job.
Spreadsheets also come as cells (table_cells), one row for each.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .web import read as read_html

#: Name spaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: An archive in an archive is read, deeper ones are not.
DEPTH = 2
MAX_PART = 256 << 20


class Encrypted(ValueError):
    pass


def _zip(data: bytes) -> zipfile.ZipFile:
    if data[:4] == b"\xd0\xcf\x11\xe0":
        raise Encrypted("encrypted or legacy container")
    return zipfile.ZipFile(io.BytesIO(data))


def _part(z: zipfile.ZipFile, name: str) -> bytes:
    info = z.getinfo(name)
    if info.flag_bits & 1:
        raise Encrypted("encrypted member")
    if info.file_size > MAX_PART:
        raise ValueError("member too large")
    return z.read(info)


def pipe(rows: list[list[str]]) -> str:
    """Rows as a pipe table, short ones filled up."""
    rows = [[re.sub(r"[ \t]+", " ", c).strip().replace("|", "\\|").replace("\n", "<br>") for c in r] for r in rows]
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _text_of(p, tag: str) -> str:
    out = []
    for x in p.iter():
        if x.tag == tag + "t":
            out.append(x.text or "")
        elif x.tag in (tag + "br", tag + "cr"):
            out.append("\n")
        elif x.tag == tag + "tab":
            out.append("\t")
    return "".join(out)


def docx(data: bytes) -> str:
    z = _zip(data)
    body = ElementTree.fromstring(_part(z, "word/document.xml")).find(W + "body")
    out: list[str] = []

    def block(p) -> str:
        style = p.find(f"{W}pPr/{W}pStyle")
        name = style.get(W + "val", "") if style is not None else ""
        text = _text_of(p, W).strip()
        level = re.fullmatch(r"(?i)(?:heading|title)\s*(\d?)", name) or re.fullmatch(r"(\d)", name)
        if text and level:
            return "#" * int(level[1] or 1) + " " + text
        return "- " + text if text and (p.find(f"{W}pPr/{W}numPr") is not None or name.lower().startswith("list")) else text

    for x in body if body is not None else ():
        if x.tag == W + "p":
            out.append(block(x))
        elif x.tag == W + "tbl":
            out.append(pipe([["\n".join(filter(None, (_text_of(p, W).strip() for p in c.iter(W + "p")))) for c in r.findall(W + "tc")] for r in x.findall(W + "tr")]))
    return "\n\n".join(filter(None, out))


def pptx(data: bytes) -> str:
    z = _zip(data)
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for k, n in enumerate(names, 1):
        root = ElementTree.fromstring(_part(z, n))
        parts = [f"<!-- slide {k} -->"]
        for tbl in root.iter(A + "tbl"):
            parts.append(pipe([[_text_of(c, A).strip() for c in r.findall(A + "tc")] for r in tbl.findall(A + "tr")]))
        inside = {id(p) for t in root.iter(A + "tbl") for p in t.iter(A + "p")}
        parts += [t for p in root.iter(A + "p") if id(p) not in inside and (t := _text_of(p, A).strip())]
        out.append("\n\n".join(filter(None, parts)))
    return "\n\n".join(out)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(name, [(row, column, text)]) of each sheet: cached values, merged areas only at their first cell, both from 0."""
    z = _zip(data)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ElementTree.fromstring(_part(z, "xl/sharedStrings.xml")).findall(S + "si")]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(_part(z, "xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(_part(z, "xl/workbook.xml")).iter(S + "sheet"):
        target = rels[sheet.get(R + "id")]
        root = ElementTree.fromstring(_part(z, posixpath.normpath(posixpath.join("xl", target)) if not target.startswith("/") else target[1:]))
        cells = []
        for r, row in enumerate(root.iter(S + "row")):
            y = int(row.get("r", r + 1)) - 1
            for i, c in enumerate(row.findall(S + "c")):
                v, kind = c.find(S + "v"), c.get("t")
                text = "".join(t.text or "" for t in c.iter(S + "t")) if kind == "inlineStr" else (v.text or "") if v is not None else ""
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "b":
                    text = {"1": "TRUE", "0": "FALSE"}.get(text, text)
                cells.append((y, _column(c.get("r")) if c.get("r") else i, text))
        out.append((sheet.get("name", ""), cells))
    return out


def xlsx(data: bytes) -> str:
    out = []
    for name, cells in sheets(data):
        if not any(t for *_, t in cells):
            continue
        rows: dict[int, dict[int, str]] = {}
        for y, x, t in cells:
            rows.setdefault(y, {})[x] = t
        width = 1 + max(x for _, x, _ in cells)
        out.append(f"## {name}\n\n" + pipe([[rows[y].get(x, "") for x in range(width)] for y in sorted(rows)]))
    return "\n\n".join(out)


def notebook(data: bytes) -> str:
    book, out = json.loads(data), []
    text = lambda x: "".join(x) if isinstance(x, list) else x or ""
    for c in book.get("cells", ()):
        if c.get("cell_type") == "markdown":
            out.append(text(c.get("source")).strip())
        elif c.get("cell_type") == "code":
            out.append("```python\n" + text(c.get("source")).rstrip() + "\n```")
            for o in c.get("outputs", ()):
                shown = text(o.get("text") or o.get("data", {}).get("text/plain"))
                if shown.strip():
                    out.append("```\n" + shown.rstrip() + "\n```")
    return "\n\n".join(filter(None, out))


def subtitles(data: bytes) -> str:
    """SRT and VTT: what is said, without numbers, times and tags; lines that repeat the one before go."""
    out: list[str] = []
    for block in re.split(r"\n\s*\n", data.decode("utf-8-sig", "replace").replace("\r\n", "\n")):
        lines = [x.strip() for x in block.strip().split("\n")]
        at = next((i for i, x in enumerate(lines) if "-->" in x), None)
        if at is None:
            continue
        said = " ".join(filter(None, (re.sub(r"<[^>]+>", "", x).strip() for x in lines[at + 1 :])))
        if said and (not out or out[-1] != said):
            out.append(said)
    return "\n".join(out)


def table_text(data: bytes) -> str:
    """CSV, the separator found out from the first lines."""
    text = _plain(data)
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    return pipe([r for r in csv.reader(io.StringIO(text), dialect) if any(c.strip() for c in r)])


def _plain(data: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    for name in ("utf-8", "gb18030"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def feed(data: bytes) -> str:
    """RSS and Atom: title, link and summary of each entry; other XML: its text."""
    root = ElementTree.fromstring(data)
    plain = lambda e: re.sub(r"\{.*\}", "", e.tag)
    items = [e for e in root.iter() if plain(e) in ("item", "entry")]
    if not items:
        return "\n".join(t.strip() for t in root.itertext() if t.strip())
    out = []
    for item in items:
        field = {plain(c): ((c.text or "").strip() or c.get("href", "")) for c in item}
        text = read_html(field.get("description") or field.get("summary") or field.get("content") or "")["text"]
        out.append("\n\n".join(filter(None, (f"## [{field.get('title', '')}]({field.get('link', '')})", text))))
    return "\n\n".join(out)


def archive(data: bytes, depth: int = DEPTH) -> str:
    z, out = _zip(data), []
    for name in sorted(z.namelist()):
        kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
        if name.endswith("/") or kind not in READERS or (kind == "zip" and depth <= 1):
            continue
        out.append(f"# {name}\n\n" + (archive(_part(z, name), depth - 1) if kind == "zip" else READERS[kind](_part(z, name))))
    return "\n\n".join(out)


READERS = {
    "docx": docx, "pptx": pptx, "xlsx": xlsx, "ipynb": notebook, "srt": subtitles, "vtt": subtitles, "csv": table_text, "zip": archive,
    "html": lambda b: read_html(_plain(b))["text"], "htm": lambda b: read_html(_plain(b))["text"], "xml": feed, "rss": feed, "atom": feed,
    "json": lambda b: "```json\n" + json.dumps(json.loads(_plain(b)), ensure_ascii=False, indent=2) + "\n```",
    "txt": _plain, "text": _plain, "log": _plain, "md": _plain, "markdown": _plain,
}


def convert(path: str, data: bytes | None) -> tuple[str | None, str | None, str | None]:
    """(md, status, message)."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if data is None:
        return None, "E_FILE_NOT_FOUND", None
    if kind not in READERS:
        return None, "E_UNSUPPORTED_FORMAT", kind
    try:
        return READERS[kind](data), None, None
    except Encrypted as e:
        return None, "E_ENCRYPTED", str(e)
    except Exception as e:  # whatever a broken file raises is that file's status
        return None, "E_MARKITDOWN", f"{type(e).__name__}: {e}"[:200]


def converted(files: DataFrame) -> DataFrame:
    """files (path, content, ...) -> path, md, status, message: a row for each file."""
    schema = pa.schema([(k, pa.string()) for k in ("path", "md", "status", "message")])

    def run(it):
        for batch in it:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (path, *convert(path or "", content.as_py()))], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, md string, status string, message string")


def table_cells(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, sheet, row, col, text: the cells of spreadsheets that can be read."""
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("col", pa.int64()), ("text", pa.string())])

    def run(it):
        for batch in it:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    rows = [(path, name, y, x, t) for name, cells in sheets(content.as_py()) for y, x, t in cells]
                except Exception:  # converted() reports it
                    continue
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.filter(F.lower("path").endswith(".xlsx")).select("path", "content").mapInArrow(run, "path string, sheet string, row long, col long, text string")
