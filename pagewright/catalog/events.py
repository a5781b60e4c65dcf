"""Queries of page events, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as E
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)
_S = "s AS (SELECT doc_id, page_no, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(duration, seq) AS duration FROM ocr_events GROUP BY doc_id, page_no)"


@query(f"WITH {_S} SELECT doc_id, page_no, seq, status, duration, CASE WHEN status <> 'done' THEN 'failed' END AS warning FROM s", "ocr_events")
def event_upsert(events):
    return E.latest(events)


@query(f"WITH {_S}, g AS (SELECT doc_id, count(*) FILTER (status = 'done')::BIGINT AS done, count(*) FILTER (status = 'failed')::BIGINT AS failed, round(avg(duration) FILTER (duration > 0), 9) AS m FROM s GROUP BY doc_id) SELECT doc_id, done, failed, m AS mean_seconds, ceil(greatest(40 - done, 0) * m)::BIGINT AS left_seconds FROM g", "ocr_events")
def progress(events):
    return E.progress(E.latest(events), 40)


@query(f"WITH {_S} SELECT doc_id, page_no FROM s WHERE status = 'done' AND (doc_id + page_no) % 6 = 0", "ocr_events")
def reconcile(events):
    return E.lost(E.latest(events), events.filter("(doc_id + page_no) % 6 <> 0").select("doc_id", "page_no").distinct())


@query(f"WITH {_S}, w AS (SELECT DISTINCT doc_id, p.i AS page_no FROM ocr_events, (SELECT unnest(range(1, 41)) AS i) p) SELECT doc_id, page_no FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = w.doc_id AND s.page_no = w.page_no AND status = 'done')", "ocr_events")
def resume_worklist(events):
    pages = events.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long"))).alias("page_no"))
    return E.worklist(pages, E.latest(events))


@query("SELECT doc_id, sum(seq % 4)::BIGINT AS failures, arg_min(concat('page ', page_no), seq) AS first FROM ocr_events WHERE seq % 4 > 0 AND kind = 'error' GROUP BY doc_id", "ocr_events")
def formula_failures(events):
    e = events.filter("kind = 'error'").select("doc_id", "seq", (F.col("seq") % 4).alias("failures"), F.concat(F.lit("page "), F.col("page_no").cast("string")).alias("message"))
    return E.formula_failures(e)


@query("SELECT seq, CASE WHEN seq % 7 = 0 THEN 'cancelled' WHEN seq % 5 = 0 THEN 'E_OCR_TIMEOUT' WHEN seq % 3 = 0 THEN 'ok' WHEN seq % 2 = 0 THEN 'E_OCR_RUN' ELSE 'crashed' END AS outcome FROM ocr_events", "ocr_events")
def terminal_outcome(events):
    m = lambda k: F.col("seq") % k == 0
    return events.select("seq", E.outcome(m(7), m(5), m(3), m(2)).alias("outcome"))


@query("SELECT doc_id, page_no, status FROM (SELECT doc_id, page_no, status, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'k1' ELSE 'k2' END AS k FROM ocr_events WHERE seq % 50 = 0) WHERE k = 'k1' OR (k IS NULL AND doc_id % 2 = 0)", "ocr_events")
def state_reuse(events):
    key = F.when(F.col("doc_id") % 3 == 1, "k1").when(F.col("doc_id") % 3 == 2, "k2")
    s = events.filter("seq % 50 = 0").select("doc_id", "page_no", "status", key.alias("state_key"), (40 + F.col("doc_id") % 2).alias("total"), F.lit(2.0).alias("scale"))
    return E.usable_state(s, "k1", 40, 2.0).select("doc_id", "page_no", "status")
