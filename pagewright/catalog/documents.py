"""Queries of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import geometry, headers
from ..operators import results as R
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)


def _docs(documents):
    return documents.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), F.col("source").alias("chain"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("md"), F.when(F.col("doc_id") % 11 == 0, "E_OCR_RUN").alias("code"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("w"), F.lit("v"))).alias("warnings"))


@query("SELECT doc_id, concat('# f', doc_id, chr(10), chr(10), trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10), chr(10), '<!-- source: f', doc_id, '.pdf | chain: ', source, ' -->', chr(10)) AS document FROM documents WHERE doc_id % 9 <> 0", "documents")
def final_document(documents):
    return R.final(_docs(documents).filter("md is not null")).select("doc_id", "document")


@query("SELECT doc_id, concat('{\"name\":\"f', doc_id, '.pdf\",\"chain\":\"', source, '\"', CASE WHEN doc_id % 11 = 0 THEN ',\"code\":\"E_OCR_RUN\"' ELSE '' END, CASE WHEN doc_id % 9 <> 0 THEN concat(',\"mdChars\":', length(text)) ELSE '' END, '}') AS result FROM documents", "documents")
def result_json(documents):
    return R.slim(_docs(documents).drop("warnings"))


@query("SELECT doc_id, ok, CASE WHEN NOT ok THEN CASE WHEN doc_id % 11 = 0 THEN 'E_OCR_RUN' ELSE 'E_UNKNOWN' END END AS code, CASE WHEN ok THEN text END AS md, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS n_warnings FROM (SELECT *, doc_id % 11 <> 0 AND doc_id % 9 <> 0 AS ok FROM documents)", "documents")
def result_canonical(documents):
    return R.canonical(_docs(documents))


_X = "SELECT doc_id, page_no, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS txt FROM (SELECT doc_id, page_no, string_split(body, chr(10)) AS ls FROM header_pages)"


@query(
    f"""WITH x AS ({_X}), z AS (SELECT *, regexp_replace(txt, '\\s+', '', 'g') AS key, line_no = 1 OR line_no = max(line_no) OVER (PARTITION BY doc_id, page_no) AS band FROM x),
b AS (SELECT DISTINCT doc_id, page_no, key FROM z WHERE band AND key <> ''), pg AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM b GROUP BY doc_id),
o AS (SELECT doc_id, key FROM b JOIN pg USING (doc_id) GROUP BY doc_id, key, pages HAVING count(*) >= greatest(2, ceil(pages * 0.6)) UNION SELECT doc_id, key FROM b WHERE regexp_matches(key, '(?i)^(版权所有.*|[0-9]+(/[0-9]+)?|第[0-9]+页(.*共[0-9]+页)?|poweredby.+)$')),
k AS (SELECT b.* FROM b JOIN o ON o.doc_id = b.doc_id AND o.key = b.key WHERE NOT EXISTS (SELECT 1 FROM z WHERE NOT band AND z.doc_id = b.doc_id AND z.page_no = b.page_no AND z.key = b.key)),
m AS (SELECT z.*, k.key IS NOT NULL AS hit FROM z LEFT JOIN k ON k.doc_id = z.doc_id AND k.page_no = z.page_no AND k.key = z.key)
SELECT doc_id, page_no, coalesce(string_agg(txt, chr(10) ORDER BY line_no) FILTER (NOT hit), '') AS body, count(*) FILTER (hit)::BIGINT AS removed FROM m GROUP BY doc_id, page_no""",
    "header_pages",
)
def hf_strip_page(pages):
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("body", "\n", -1)).alias("i", "txt")).select("doc_id", "page_no", (F.col("i") + 1).cast("long").alias("line_no"), "txt")
    return R.strip_keys(lines, headers.by_page(lines))


@query("SELECT w.doc_id, count(DISTINCT p.page_no)::BIGINT AS pages, count(DISTINCT w.page_no)::BIGINT AS expected, count(DISTINCT p.page_no) = count(DISTINCT w.page_no) AS ok FROM wanted_pages w LEFT JOIN doc_pages p USING (doc_id, page_no) GROUP BY w.doc_id", "wanted_pages", "doc_pages")
def engine_pages(wanted, pages):
    return R.engine_pages(pages, wanted.groupBy("doc_id").agg(F.count_distinct("page_no").alias("expected")))


@query("SELECT w.doc_id, w.page_no FROM wanted_pages w JOIN doc_pages p USING (doc_id, page_no) WHERE w.page_no % 2 = 1", "wanted_pages", "doc_pages")
def requested_pages(wanted, pages):
    return R.requested(wanted.filter("page_no % 2 = 1"), pages).select("doc_id", "page_no")


@query("SELECT doc_id, page_no, page_no AS page FROM doc_pages WHERE page_no % 3 <> 0 UNION ALL SELECT doc_id, page_no, NULL FROM doc_pages WHERE page_no % 3 = 0", "doc_pages")
def figures_by_name(pages):
    name = F.when(F.col("page_no") % 3 == 0, "cover.png").when(F.col("page_no") % 3 == 1, F.format_string("%03d-fig.png", "page_no")).otherwise(F.format_string("p-%02d.png", "page_no"))
    return pages.select("doc_id", "page_no", R.page_of(name).alias("page"))


@query("SELECT doc_id, b + 1 AS batch, string_agg(page_no::VARCHAR, ',' ORDER BY page_no) AS pages, printf('batch-%d-%03d.md', doc_id, b + 1) AS output FROM (SELECT doc_id, page_no, (row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1) // 8 AS b FROM doc_pages WHERE (doc_id + page_no) % 2 = 0) GROUP BY doc_id, b", "doc_pages")
def auto_brief(pages):
    return R.brief(pages.withColumn("hint", (F.col("doc_id") + F.col("page_no")) % 2 == 0))


@query("SELECT doc_id, page_no, concat('a ', CASE WHEN page_no % 2 = 0 THEN concat('![](c', page_no, '.png)') ELSE '<!-- crop rejected -->' END, ' b crop:other') AS body FROM doc_pages", "doc_pages")
def crop_rewrite(pages):
    ref = F.format_string("crop:%d", "page_no")
    crops = pages.select("doc_id", "page_no", ref.alias("ref"), F.when(F.col("page_no") % 2 == 0, F.format_string("c%d.png", "page_no")).alias("file"))
    return R.rewrite_crops(pages.withColumn("body", F.concat(F.lit("a "), ref, F.lit(" b crop:other"))), crops)


@query("SELECT page_no, sum(label)::DOUBLE >= 190 * 0.9 AS taken FROM boxes GROUP BY page_no", "boxes")
def rebuild_accept(boxes):
    return boxes.groupBy("page_no").agg(F.sum("label").alias("n")).select("page_no", geometry.rebuilt_counts(F.col("n").cast("double"), F.lit(190)).alias("taken"))


@query("SELECT doc_id, array_to_string(list_concat(CASE WHEN doc_id % 2 = 0 THEN ['w', 'v'] ELSE [] END, CASE WHEN doc_id % 3 = 0 THEN ['w', source] ELSE [] END), ',') AS warnings FROM documents", "documents")
def warning_union(documents):
    after = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("w"), F.col("source")))
    return _docs(documents).join(documents.select("doc_id", after.alias("after")), "doc_id").select("doc_id", F.array_join(R.all_warnings(F.col("warnings"), F.col("after")), ",").alias("warnings"))


@query("SELECT doc_id, printf('pages=%d failed=%d hits=%d', count(*), count(*) FILTER (status = 'failed'), coalesce(sum(CASE WHEN kind = 'purchase' THEN seq % 5 END), 0)::BIGINT) AS notes FROM ocr_events GROUP BY doc_id", "ocr_events")
def notes_bag(events):
    facts = events.select("doc_id", F.lit(1).alias("pages"), (F.col("status") == "failed").cast("int").alias("failed"), F.when(F.col("kind") == "purchase", F.col("seq") % 5).alias("hits"))
    n = lambda k: F.col("notes")[k]
    return R.notes(facts).select("doc_id", F.format_string("pages=%d failed=%d hits=%d", n("pages"), n("failed"), n("hits")).alias("notes"))


@query("SELECT doc_id, array_to_string(ws[:50], ' ') AS hits, left(text, 20000) AS cell FROM (SELECT doc_id, text, string_split(text, ' ') AS ws FROM documents)", "documents")
def evidence_caps(documents):
    """The caps are the rule: evidence of a kind is the first so many items."""
    return documents.select("doc_id", F.array_join(R.capped(F.split("text", " ", -1), "hits"), " ").alias("hits"), R.capped(F.col("text"), "cell_chars").alias("cell"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'wps,office' ELSE 'libreoffice' END AS backends FROM documents", "documents")
def legacy_backends(documents):
    return documents.select("doc_id", F.array_join(paths.backends(F.when(F.col("doc_id") % 2 == 0, "win32").otherwise("linux")), ",").alias("backends"))
