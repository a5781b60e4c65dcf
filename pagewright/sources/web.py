"""HTML pages as Markdown: headings, paragraphs, lists, links, tables. The standard library's parser runs over Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIP = {"script", "style", "template", "noscript", "head"}
BLOCKS = {"p", "div", "article", "section", "header", "footer", "nav", "main", "aside", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "hr"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.title, self.links, self.headings, self.cells, self.in_title, self.href = [], 0, "", [], [], None, False, None

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in SKIP:
            self.skip += 1
        elif tag in BLOCKS:
            self.out.append("\n")
            if re.fullmatch("h[1-6]", tag):
                self.headings.append([int(tag[1]), ""])
                self.out.append("#" * int(tag[1]) + " ")
            elif tag == "li":
                self.out.append("- ")
            elif tag == "tr":
                self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        elif tag == "a":
            self.href = dict(attrs).get("href")
            if self.href is not None:
                self.links.append([self.href, ""])

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "tr" and self.cells is not None:
            if self.cells:
                self.out.append("| " + " | ".join(c.strip().replace("|", "\\|") for c in self.cells) + " |")
            self.cells = None
        elif tag == "a":
            self.href = None
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if self.skip or self.in_title:
            return
        data = re.sub(r"\s+", " ", data)
        if self.headings and self.out and self.out[-1].startswith("#"):
            self.headings[-1][1] += data.strip()
        if self.href is not None and self.links:
            self.links[-1][1] += data
        if self.cells:
            self.cells[-1] += data
        else:
            self.out.append(data)


def read(html: str | None) -> dict:
    r = _Reader()
    r.feed(html or "")
    r.close()
    lines = [re.sub(r" +", " ", x).strip() for x in "".join(r.out).split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return {"title": r.title.strip(), "text": text, "headings": [{"level": n, "text": t} for n, t in r.headings], "links": [{"href": h, "text": t.strip()} for h, t in r.links]}


SCHEMA = "struct<title:string,text:string,headings:array<struct<level:int,text:string>>,links:array<struct<href:string,text:string>>>"
_TYPE = pa.struct([("title", pa.string()), ("text", pa.string()), ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))), ("links", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])))])


def html_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with title, text (Markdown), headings and links beside their own columns."""

    @F.arrow_udf(SCHEMA)
    def reader(html: pa.Array) -> pa.Array:
        return pa.array([read(x) for x in html.to_pylist()], _TYPE)

    return pages.withColumn("_r", reader(F.col(column))).select(*pages.columns, "_r.*")
