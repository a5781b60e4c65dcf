"""Queries of routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as R
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)


@query("SELECT doc_id, total, CASE WHEN total <= 3 THEN array_to_string(range(1, total + 1), ',') ELSE array_to_string(list_sort(list_distinct([1, greatest(2, total // 3), least(total, greatest(greatest(2, total // 3) + 1, (2 * total) // 3))])), ',') END AS pages FROM (SELECT doc_id, 1 + doc_id % 97 AS total FROM documents)", "documents")
def probe_pages(documents):
    total = 1 + F.col("doc_id") % 97
    return documents.select("doc_id", total.alias("total"), F.array_join(R.probe_pages(total), ",").alias("pages"))


_C = "c AS (SELECT doc_id, count(*) FILTER (bad = 0) > 0 AS valid, coalesce(sum(tables) FILTER (bad = 0), 0)::BIGINT AS tables, coalesce(sum(formulas) FILTER (bad = 0), 0)::BIGINT AS formulas, coalesce(sum(text_regions) FILTER (bad = 0), 0)::BIGINT AS text_regions, count(*)::BIGINT AS total FROM (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS last FROM probe) WHERE CASE WHEN last <= 3 THEN true ELSE page_no IN (1, greatest(2, last // 3), least(last, greatest(greatest(2, last // 3) + 1, 2 * last // 3))) END GROUP BY doc_id), r AS (SELECT *, CASE WHEN tables + formulas + text_regions > 0 THEN (tables + formulas)::DOUBLE / (tables + formulas + text_regions) ELSE 0.0::DOUBLE END AS ratio FROM c)"


def _complexity(probe):
    last = probe.groupBy("doc_id").agg(F.max("page_no").alias("last"))
    wanted = last.select("doc_id", F.explode(R.probe_pages(F.col("last"))).alias("page_no"))
    few = probe.join(wanted, ["doc_id", "page_no"], "left_semi").withColumn("error", F.when(F.col("bad") == 1, "failed"))
    return R.complexity(few).join(few.groupBy("doc_id").agg(F.count("*").alias("total")), "doc_id")


@query(f"WITH {_C} SELECT doc_id, valid, tables, formulas, text_regions, round(ratio, 6) AS ratio FROM r", "probe")
def complexity_ratio(probe):
    return _complexity(probe).select("doc_id", "valid", "tables", "formulas", "text_regions", F.round("ratio", 6).alias("ratio"))


@query(
    f"""WITH {_C}, e AS (SELECT *, CASE doc_id % 10 WHEN 0 THEN 'vision' WHEN 1 THEN 'local' ELSE 'auto' END AS engine FROM r)
SELECT doc_id, CASE WHEN engine <> 'auto' THEN engine WHEN valid AND (total > 4 OR ratio > 0.4) THEN 'vision' ELSE 'local' END AS route, CASE WHEN engine <> 'auto' THEN 'asked for' WHEN NOT valid THEN 'no probe' WHEN total > 4 THEN 'too many pages' WHEN ratio > 0.4 THEN 'complex' ELSE 'simple' END AS reason,
  engine = 'auto' AND valid AND total <= 4 AND ratio <= 0.4 AND ratio >= 0.4 * 0.7 AS hint FROM e""",
    "probe",
)
def route_decision(probe):
    engine = F.when(F.col("doc_id") % 10 == 0, "vision").when(F.col("doc_id") % 10 == 1, "local").otherwise("auto")
    return R.decide(_complexity(probe).withColumn("engine", engine), limit=4).select("doc_id", "route", "reason", "hint")


_CAND = """SELECT doc_id, engine, CASE WHEN engine = 'primary' AND doc_id % 2 = 0 THEN repeat('x', CAST(doc_id % 40 AS INT)) ELSE text END AS md, CASE engine WHEN 'primary' THEN doc_id % 100 WHEN 'second' THEN (doc_id * 7) % 100 ELSE 50 END AS score, doc_id % 3 = 0 AS rebuilt FROM documents CROSS JOIN (SELECT 'primary' AS engine UNION ALL SELECT 'second' UNION ALL SELECT 'fallback') AS e"""


@query(
    f"""WITH k AS ({_CAND}), u AS (SELECT *, max(CASE WHEN engine = 'primary' THEN score END) OVER (PARTITION BY doc_id) AS p FROM k WHERE length(md) >= 20),
r AS (SELECT *, CASE WHEN engine = 'second' AND p IS NOT NULL AND (score > p OR (rebuilt AND score >= p - 10)) THEN 0 WHEN engine = 'primary' THEN 1 WHEN engine = 'fallback' THEN 2 END AS rk FROM u)
SELECT doc_id, engine, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rk) AS n FROM r WHERE rk IS NOT NULL) WHERE n = 1""",
    "documents",
)
def candidate_choice(documents):
    engines = F.explode(F.array(F.lit("primary"), F.lit("second"), F.lit("fallback")))
    k = documents.select("doc_id", "text", engines.alias("engine"))
    score = F.when(F.col("engine") == "primary", F.col("doc_id") % 100).when(F.col("engine") == "second", F.col("doc_id") * 7 % 100).otherwise(50)
    k = k.select("doc_id", "engine", F.expr("case when engine = 'primary' and doc_id % 2 = 0 then repeat('x', cast(doc_id % 40 as int)) else text end").alias("md"), score.alias("score"), (F.col("doc_id") % 3 == 0).alias("rebuilt"))
    return R.candidate(k).select("doc_id", "engine", "score")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 61 > 30 THEN 'E_FOREGROUND_LIMIT' END AS status FROM documents", "documents")
def page_gate(documents):
    return documents.select("doc_id", R.gate(F.col("doc_id") % 61, F.col("doc_id") % 2 == 0).alias("status"))


@query("SELECT doc_id, CASE WHEN doc_id % 61 > 0 THEN (ceil((doc_id % 61) * 27.0::DOUBLE / greatest(doc_id % 5, 1)) + CASE WHEN doc_id % 5 > 1 THEN 40 ELSE 0 END)::BIGINT END AS eta FROM documents", "documents")
def eta_static(documents):
    return documents.select("doc_id", R.eta(F.col("doc_id") % 61, F.col("doc_id") % 5).cast("long").alias("eta"))


@query("SELECT doc_id, CASE WHEN greatest(40 - done, 0) = 0 THEN 0 ELSE ceil(round(greatest(40 - done, 0) * m / 4, 6)) END::BIGINT AS eta FROM (SELECT doc_id, count(DISTINCT CASE WHEN status = 'done' THEN page_no END) AS done, round(avg(CASE WHEN duration > 0 THEN duration END), 6) AS m FROM ocr_events GROUP BY doc_id)", "ocr_events")
def eta_adaptive(events):
    e = events.groupBy("doc_id").agg(F.count_distinct(F.when(F.col("status") == "done", F.col("page_no"))).alias("done"), F.round(F.avg(F.when(F.col("duration") > 0, F.col("duration"))), 6).alias("m"))
    return e.select("doc_id", R.eta_left(F.round(F.col("m"), 6), F.col("done"), F.lit(40), F.lit(4)).cast("long").alias("eta"))


@query("SELECT event_id, greatest(1, least(1 + event_id % 16, 4, greatest(1, floor((event_id % 64) * 268435456.0::DOUBLE / 2684354560)::BIGINT)))::BIGINT AS workers FROM events WHERE event_id % 64 > 0", "events")
def worker_default(events):
    return events.filter("event_id % 64 > 0").select("event_id", R.workers(1 + F.col("event_id") % 16, F.col("event_id") % 64 * 268435456).cast("long").alias("workers"))


@query(
    """WITH d AS (SELECT doc_id, 'k' || doc_id % 50 AS key, CASE doc_id % 10 WHEN 0 THEN 'vision' WHEN 1 THEN 'local' ELSE 'auto' END AS engine, doc_id % 7 AS total, doc_id % 4 <> 0 AS ok FROM documents),
p AS (SELECT 'k' || i AS key, i % 6 <> 0 AS valid, (i % 10) / 10.0::DOUBLE AS ratio, i % 3 = 0 AS cached FROM range(0, 45) t(i)),
b AS (SELECT d.*, coalesce(p.cached AND p.valid, false) AS hit, p.valid AS pv, coalesce(p.ratio, 0.0::DOUBLE) AS r FROM d LEFT JOIN p USING (key)),
c AS (SELECT *, CASE WHEN hit THEN 'cache' WHEN pv IS NOT NULL THEN 'fresh' ELSE 'none' END AS probe, coalesce(pv, false) AS valid FROM b),
e AS (SELECT *, CASE WHEN engine <> 'auto' THEN engine WHEN valid AND (total > 4 OR r > 0.4) THEN 'vision' ELSE 'local' END AS route FROM c)
SELECT doc_id, probe, route, CASE WHEN route = 'vision' AND NOT ok AND engine = 'auto' THEN 'local' ELSE route END AS used, route = 'vision' AND NOT ok AND engine = 'auto' AS fell_back FROM e""",
    "documents",
)
def scan_route(documents):
    """Probe results of 45 keys, a third of them cached."""
    c = F.col("doc_id")
    docs = documents.select("doc_id", F.concat(F.lit("k"), (c % 50).cast("string")).alias("key"), F.when(c % 10 == 0, "vision").when(c % 10 == 1, "local").otherwise("auto").alias("engine"), (c % 7).alias("total"), (c % 4 != 0).alias("vision_ok"))
    keys = documents.sparkSession.range(0, 45).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 6 != 0).alias("valid"), ((F.col("id") % 10) / 10.0).alias("ratio"), F.lit(2.0).alias("seconds"), (F.col("id") % 3 == 0).alias("cached"))
    return R.scanned(docs, keys.filter("cached"), keys, limit=4).select("doc_id", "probe", "route", "used", "fell_back")
