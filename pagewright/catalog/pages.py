"""Queries of pages, batches and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)

_BLOCK = "concat('<!--PAGE:', CASE WHEN page_no < 10 THEN '0' ELSE '' END, page_no, '-->', chr(10), chr(10), CASE WHEN trim(body) = '' THEN '' ELSE concat(trim(body), chr(10), chr(10)) END, '<!--/PAGE:', CASE WHEN page_no < 10 THEN '0' ELSE '' END, page_no, '-->')"


@query(f"SELECT doc_id, concat('# ', doc_id, chr(10), chr(10), string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY page_no)) AS md FROM doc_pages GROUP BY doc_id", "doc_pages")
def assemble_pages(pages):
    return A.assembled(pages)


@query("SELECT doc_id, page_no, trim(body) AS body FROM doc_pages", "doc_pages")
def parse_anchors(pages):
    """Assembled and read again; a block that comes twice counts with its last body."""
    md = A.assembled(pages.withColumn("body", F.lit("old")), title=False).withColumnRenamed("md", "first").join(A.assembled(pages), "doc_id")
    return A.parsed(md.withColumn("md", F.concat("first", F.lit("\n\n"), "md")))


@query("SELECT doc_id, count(p.page_no)::BIGINT AS found, count(*)::BIGINT AS total FROM wanted_pages w LEFT JOIN doc_pages p USING (doc_id, page_no) GROUP BY doc_id", "wanted_pages", "doc_pages")
def coverage(wanted, pages):
    return A.coverage(wanted, pages)


@query("SELECT doc_id, page_no, batch FROM wanted_pages w WHERE NOT EXISTS (SELECT 1 FROM doc_pages p WHERE p.doc_id = w.doc_id AND p.page_no = w.page_no)", "wanted_pages", "doc_pages")
def missing_pages(wanted, pages):
    return A.missing(wanted, pages).select("doc_id", "page_no", "batch")


_OUT = """SELECT doc_id, CASE WHEN (doc_id + page_no) % 10 = 0 THEN batch + 1 ELSE batch END AS batch, page_no AS seq, page_no, body FROM doc_pages
UNION ALL SELECT doc_id, batch, 1000 + page_no, page_no, 'again' FROM doc_pages WHERE (doc_id + page_no) % 9 = 0 AND (doc_id + page_no) % 10 <> 0"""


def _blocks(pages):
    return pages.sparkSession.sql(_OUT.replace("doc_pages", "{p}"), p=pages)


@query(f"WITH o AS ({_OUT}) SELECT doc_id, batch, page_no, count(*)::BIGINT AS times, arg_min(body, seq) AS body FROM o GROUP BY ALL HAVING count(*) > 1".replace("GROUP BY ALL", "GROUP BY doc_id, batch, page_no"), "doc_pages")
def duplicate_anchors(pages):
    return A.duplicates(_blocks(pages))


@query(f"WITH o AS ({_OUT}) SELECT DISTINCT o.doc_id, o.page_no, o.batch, w.batch AS owner FROM o LEFT JOIN wanted_pages w ON w.doc_id = o.doc_id AND w.page_no = o.page_no WHERE w.batch IS DISTINCT FROM o.batch", "doc_pages", "wanted_pages")
def foreign_anchors(pages, wanted):
    return A.foreign(_blocks(pages), wanted)


@query("SELECT doc_id, page_no, length(regexp_replace(body, '\\s+', '', 'g'))::BIGINT AS visible FROM doc_pages WHERE length(regexp_replace(body, '\\s+', '', 'g')) < 10", "doc_pages")
def short_pages(pages):
    from ..functions.text import visible_length

    return pages.select("doc_id", "page_no", visible_length(F.col("body")).cast("long").alias("visible")).filter("visible < 10")


_STATE = "SELECT DISTINCT doc_id, batch, CASE WHEN (doc_id + batch) % 8 = 0 THEN 'missing' WHEN (doc_id + batch) % 13 = 0 THEN 'not utf-8' ELSE 'ok' END AS state FROM wanted_pages"
_FINDINGS = f"""
o AS ({_OUT}), st AS ({_STATE}), bad AS (SELECT * FROM st WHERE state <> 'ok'),
good AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.doc_id = o.doc_id AND b.batch = o.batch)),
kept AS (SELECT doc_id, page_no, arg_min(body, (batch, seq)) AS body FROM good GROUP BY doc_id, page_no),
fs AS (
SELECT b.doc_id, CASE WHEN state = 'not utf-8' THEN NULL ELSE min(page_no) END AS page_no, CASE WHEN state = 'not utf-8' THEN 'blocker' ELSE 'high' END AS severity, concat('output ', state) AS problem, b.batch::VARCHAR AS evidence FROM bad b JOIN wanted_pages w ON w.doc_id = b.doc_id AND w.batch = b.batch GROUP BY b.doc_id, b.batch, state
UNION ALL SELECT DISTINCT g.doc_id, g.page_no, 'medium', 'foreign anchor', g.batch::VARCHAR FROM good g LEFT JOIN wanted_pages w ON w.doc_id = g.doc_id AND w.page_no = g.page_no WHERE w.batch IS DISTINCT FROM g.batch
UNION ALL SELECT doc_id, page_no, 'high', 'duplicate anchor', count(*)::VARCHAR FROM good GROUP BY doc_id, batch, page_no HAVING count(*) > 1
UNION ALL SELECT w.doc_id, w.page_no, 'high', 'missing page', w.batch::VARCHAR FROM wanted_pages w WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = w.doc_id AND k.page_no = w.page_no) AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.doc_id = w.doc_id AND b.batch = w.batch)
UNION ALL SELECT doc_id, page_no, 'medium', 'very short page', length(regexp_replace(body, '\\s+', '', 'g'))::VARCHAR FROM kept WHERE length(regexp_replace(body, '\\s+', '', 'g')) < 10
UNION ALL SELECT doc_id, page_no, 'medium', 'mojibake', least(len(regexp_extract_all(body, '[À-ÿ]{{4,}}')), 50)::VARCHAR FROM kept WHERE regexp_matches(body, '[À-ÿ]{{4,}}'))"""


def _found(pages, wanted):
    outputs = wanted.sparkSession.sql(_STATE.replace("wanted_pages", "{w}"), w=wanted)
    return A.findings(_blocks(pages), wanted, outputs)


@query(f"WITH {_FINDINGS} SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(page_no, -1), CASE severity WHEN 'blocker' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, problem, evidence)::INT AS place FROM fs", "doc_pages", "wanted_pages")
def findings(pages, wanted):
    return A.ranked(_found(pages, wanted))


@query(
    f"""WITH {_FINDINGS} SELECT w.doc_id, w.batch, string_agg(w.page_no::VARCHAR, ',' ORDER BY w.page_no) AS pages, printf('review/%d-%03d.md', w.doc_id, w.batch) AS output FROM wanted_pages w
WHERE EXISTS (SELECT 1 FROM fs f WHERE f.doc_id = w.doc_id AND f.page_no = w.page_no AND f.severity IN ('high', 'medium')) GROUP BY w.doc_id, w.batch""",
    "doc_pages",
    "wanted_pages",
)
def review_batches(pages, wanted):
    return A.review(_found(pages, wanted), wanted)


@query("SELECT doc_id, page_no, CASE WHEN page_no % 2 = 0 THEN concat('new ', page_no) ELSE body END AS body FROM (SELECT doc_id, page_no, body FROM doc_pages UNION ALL SELECT doc_id, page_no, 'x' FROM wanted_pages w WHERE page_no % 2 = 0 AND NOT EXISTS (SELECT 1 FROM doc_pages p WHERE p.doc_id = w.doc_id AND p.page_no = w.page_no))", "doc_pages", "wanted_pages")
def subset_merge(pages, wanted):
    new = wanted.filter("page_no % 2 = 0").select("doc_id", "page_no", F.concat(F.lit("new "), F.col("page_no").cast("string")).alias("body"))
    return A.merged(pages, new)


@query("SELECT doc_id, b + 1 AS batch, string_agg(page_no::VARCHAR, ',' ORDER BY page_no) AS pages, printf('batch-%d-%03d.md', doc_id, b + 1) AS output FROM (SELECT doc_id, page_no, (row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1) // 3 AS b FROM doc_pages) GROUP BY doc_id, b", "doc_pages")
def batches(pages):
    return A.batched(pages, 3)


@query("SELECT doc_id, page_no, CASE WHEN page_no % 3 = 0 THEN body WHEN page_no % 3 = 1 THEN concat(body, chr(10), chr(10), '![](f', doc_id, '-0.png)', chr(10), '![](f', doc_id, '-1.png)') ELSE concat(body, ' f', doc_id, '-0.png') END AS body FROM doc_pages", "doc_pages")
def figures_inject(pages):
    images = pages.filter("page_no % 3 <> 0").select("doc_id", "page_no", F.explode(F.array(F.lit(1), F.lit(0))).alias("seq")).withColumn("file", F.format_string("f%d-%d.png", "doc_id", "seq"))
    there = pages.withColumn("body", F.when(F.col("page_no") % 3 == 2, F.format_string("%s f%d-0.png", "body", "doc_id")).otherwise(F.col("body")))
    return A.with_figures(there, images)


@query("SELECT doc_id, min(page_no) AS page_no, concat('g', page_no % 4, '.png') AS path, 'E_FIGURE_MISSING' AS code FROM doc_pages WHERE (doc_id + page_no % 4) % 3 <> 0 GROUP BY doc_id, page_no % 4", "doc_pages")
def figure_refs(pages):
    own = F.concat(F.lit("![a](g"), (F.col("page_no") % 4).cast("string"), F.lit(".png)"))
    body = pages.withColumn("body", F.concat("body", own, F.lit(" ![](https://x/y.png) ![](data:z) "), own))
    files = pages.filter((F.col("doc_id") + F.col("page_no") % 4) % 3 == 0).select("doc_id", F.concat(F.lit("g"), (F.col("page_no") % 4).cast("string"), F.lit(".png")).alias("path")).distinct()
    return A.missing_figures(body, files)


@query("SELECT page_no AS doc_id, string_agg(printf('p%d (%.1f%%)', box_id, ratio * 100), ', ' ORDER BY box_id) AS message FROM (SELECT page_no, box_id, label / 20.0::DOUBLE AS ratio FROM boxes) WHERE ratio >= 0.15 GROUP BY page_no", "boxes")
def vision_hints(boxes):
    return A.vision_hints(boxes.select(F.col("page_no").alias("doc_id"), F.col("box_id").alias("page_no"), (F.col("label") / 20.0).alias("ratio")))


@query(None, "boxes")
def crop_plan(boxes):
    """Crop requests of a page: the same box again, boxes without area, more than the limit."""
    twice = boxes.select(F.col("page_no").alias("doc_id"), (F.col("box_id") % 3).alias("page_no"), F.explode(F.array(F.col("box_id"), F.col("box_id") + 1000)).alias("seq"), "x1", "y1", F.when(F.col("box_id") % 7 == 0, F.col("x1")).otherwise(F.col("x2")).alias("x2"), "y2")
    return A.crop_plan(twice)


@query(f"SELECT w.doc_id, concat('# ', w.doc_id, chr(10), chr(10), string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY page_no)) AS md FROM (SELECT w.doc_id, w.page_no, CASE WHEN p.page_no IS NULL THEN concat('<!-- page ', w.page_no, ' is missing: see the findings -->') ELSE coalesce(body, '') END AS body FROM wanted_pages w LEFT JOIN doc_pages p ON p.doc_id = w.doc_id AND p.page_no = w.page_no) AS w GROUP BY w.doc_id", "doc_pages", "wanted_pages")
def assemble_whole(pages, wanted):
    return A.assembled_whole(pages, wanted)


@query("SELECT doc_id, max(page_no)::BIGINT AS pages FROM doc_pages GROUP BY doc_id", "doc_pages")
def page_count(pages):
    return A.page_count(pages).select("doc_id", F.col("pages").cast("long"))


@query("SELECT doc_id, page_no FROM doc_pages WHERE page_no <= 3", "doc_pages")
def first_pages(pages):
    return A.first_pages(pages, 3).select("doc_id", "page_no")
