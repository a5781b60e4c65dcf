"""Queries of headers, markers and headings. Positioned lines are made from text: 12 points each from the top of a page of 800."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import headers as H
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)

_LINES = """SELECT doc_id, page_no, line_no, CAST(790 - 12 * line_no - h AS DOUBLE) AS yb, CAST(790 - 12 * line_no AS DOUBLE) AS yt, CAST(150 AS DOUBLE) AS page_h, txt FROM (
  SELECT doc_id, page_no, line_no, txt, CASE WHEN line_no = 2 THEN 20 WHEN (doc_id + line_no) % 3 = 0 THEN 10 ELSE 9 END AS h FROM x) AS y"""
#: Lines of headed pages; the page is 150 points high, from 640 to 790, moved down to 0.
_X = "SELECT doc_id, page_no, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS txt FROM (SELECT doc_id, page_no, string_split(body, chr(10)) AS ls FROM header_pages)"
_P = f"""x AS ({_X}), l AS (SELECT doc_id, page_no, line_no, yb - 640 AS yb, yt - 640 AS yt, page_h, txt FROM ({_LINES})),
z AS (SELECT *, regexp_replace(txt, '\\s+', '', 'g') AS key, CASE WHEN yt >= page_h * 0.88 THEN 'top' WHEN yb <= page_h * 0.12 THEN 'bottom' END AS zone FROM l),
pg AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM l GROUP BY doc_id),
k AS (SELECT DISTINCT doc_id, key FROM (SELECT z.doc_id, key FROM z JOIN pg USING (doc_id) WHERE zone IS NOT NULL GROUP BY z.doc_id, zone, key, pages HAVING count(*) >= greatest(2, ceil(pages * 0.6)))
  UNION SELECT doc_id, key FROM z WHERE zone IS NOT NULL AND regexp_matches(txt, '(?i)^\\s*((copyright|©|\\(c\\)).*|[0-9]{{1,4}}(\\s*/\\s*[0-9]{{1,4}})?|page\\s+[0-9]+(\\s+of\\s+[0-9]+)?|powered by .*)\\s*$'))"""


def _lines(pages):
    x = pages.select("doc_id", "page_no", F.posexplode(F.split("body", "\n", -1)).alias("i", "txt")).select("doc_id", "page_no", (F.col("i") + 1).cast("long").alias("line_no"), "txt")
    return pages.sparkSession.sql(_LINES.replace("FROM x", "FROM {x}"), x=x).withColumn("yb", F.col("yb") - 640).withColumn("yt", F.col("yt") - 640)


@query(f"WITH {_P.replace('{{', '{').replace('}}', '}')} SELECT doc_id, key FROM k", "header_pages")
def hf_candidates_geo(pages):
    return H.geometric(_lines(pages))


@query(
    f"""WITH {_P.replace("{{", "{").replace("}}", "}")}, g AS (SELECT z.*, k.key IS NOT NULL AND zone IS NOT NULL AS hit FROM z LEFT JOIN k ON k.doc_id = z.doc_id AND k.key = z.key), c AS (SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY doc_id, page_no) AS rest FROM g)
SELECT doc_id, page_no, line_no, txt FROM c WHERE NOT (hit AND rest > 0)""",
    "header_pages",
)
def hf_strip(pages):
    lines = _lines(pages)
    return H.stripped(lines, H.geometric(lines)).select("doc_id", "page_no", "line_no", "txt")


@query(
    f"""WITH x AS ({_X}), z AS (SELECT *, regexp_replace(txt, '\\s+', '', 'g') AS key, line_no = 1 OR line_no = max(line_no) OVER (PARTITION BY doc_id, page_no) AS band FROM x),
b AS (SELECT DISTINCT doc_id, page_no, key FROM z WHERE band AND key <> ''), pg AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM b GROUP BY doc_id),
o AS (SELECT doc_id, key FROM b JOIN pg USING (doc_id) GROUP BY doc_id, key, pages HAVING count(*) >= greatest(2, ceil(pages * 0.6)) UNION SELECT doc_id, key FROM b WHERE regexp_matches(key, '(?i)^(版权所有.*|[0-9]+(/[0-9]+)?|第[0-9]+页(.*共[0-9]+页)?|poweredby.+)$'))
SELECT b.doc_id, b.page_no, b.key FROM b JOIN o ON o.doc_id = b.doc_id AND o.key = b.key WHERE NOT EXISTS (SELECT 1 FROM z WHERE NOT band AND z.doc_id = b.doc_id AND z.page_no = b.page_no AND z.key = b.key)""",
    "header_pages",
)
def hf_candidates_page(pages):
    x = pages.select("doc_id", "page_no", F.posexplode(F.split("body", "\n", -1)).alias("i", "txt")).select("doc_id", "page_no", (F.col("i") + 1).cast("long").alias("line_no"), "txt")
    return H.by_page(x)


@query(
    f"""WITH x AS ({_X}), l AS ({_LINES}), b AS (SELECT doc_id, round_even((yt - yb) * 2, 0) / 2 AS bin, page_no, line_no FROM l WHERE yt > yb),
g AS (SELECT doc_id, bin, count(*) AS n, min((page_no, line_no)) AS first FROM b GROUP BY doc_id, bin)
SELECT doc_id, bin AS body_h FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM g) WHERE r = 1""",
    "header_pages",
)
def body_height(pages):
    return H.body_height(_lines(pages))


_MARKED = "CASE WHEN line_no % 5 = 2 THEN '•' WHEN line_no % 7 = 3 THEN concat(line_no, '.') WHEN line_no % 11 = 4 THEN '12' ELSE line END"


@query(
    f"""WITH m AS (SELECT doc_id, 1 AS page_no, line_no, {_MARKED} AS txt FROM doc_lines),
k AS (SELECT *, CASE WHEN regexp_matches(txt, '^\\s*[•●○▪■◦·*-]\\s*$') THEN '-' WHEN regexp_matches(txt, '^\\s*[0-9]{{1,3}}[.、)]?\\s*$') THEN CASE WHEN regexp_matches(trim(txt), '[.、]$') THEN trim(txt) ELSE concat(trim(txt), '.') END END AS mk FROM m),
n AS (SELECT *, lag(mk) OVER (PARTITION BY doc_id ORDER BY line_no) AS own FROM k)
SELECT doc_id, line_no, CASE WHEN own IS NOT NULL THEN concat(own, ' ', txt) ELSE txt END AS txt FROM n WHERE mk IS NULL""",
    "doc_lines",
)
def orphan_merge(lines):
    m = lines.selectExpr("doc_id", "1 as page_no", "line_no", f"{_MARKED} as txt")
    return H.orphans(m).select("doc_id", "line_no", "txt")


@query(None, "header_pages")
def heading_rebuild(pages):
    lines = _lines(pages)
    return H.headings(lines, H.body_height(lines))


_TABLES = "SELECT DISTINCT doc_id, page_no, 1 + (doc_id + page_no) % 2 AS table_no, CAST(130 - 30 * ((doc_id + page_no) % 3) AS DOUBLE) AS y_top, CAST(100 - 30 * ((doc_id + page_no) % 3) AS DOUBLE) AS y_bot, concat('| T', page_no, ' |') AS md FROM header_pages"


def _tables(pages):
    return pages.sparkSession.sql(_TABLES.replace("header_pages", "{p}"), p=pages)


@query(f"WITH {_P.replace('{{', '{').replace('}}', '}')}, t AS ({_TABLES}) SELECT doc_id, page_no, line_no, txt FROM l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = l.doc_id AND t.page_no = l.page_no AND (yb + yt) / 2 BETWEEN y_bot AND y_top)", "header_pages")
def table_line_suppression(pages):
    return H.outside_tables(_lines(pages), _tables(pages)).select("doc_id", "page_no", "line_no", "txt")


@query(
    f"""WITH {_P.replace("{{", "{").replace("}}", "}")}, t AS ({_TABLES}), s AS (SELECT t.doc_id, t.page_no, md, coalesce(min(line_no) FILTER (yt < y_top), 4611686018427387904) AS slot FROM t LEFT JOIN l USING (doc_id, page_no) GROUP BY t.doc_id, t.page_no, md),
u AS (SELECT doc_id, page_no, slot AS a, 0 AS b, md AS txt FROM s UNION ALL SELECT doc_id, page_no, line_no, 1, txt FROM l)
SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY a, b)::BIGINT AS place, txt FROM u""",
    "header_pages",
)
def interleave(pages):
    return H.interleaved(_lines(pages), _tables(pages))
