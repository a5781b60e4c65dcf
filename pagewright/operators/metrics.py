"""Metrics of converted documents, and their comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cjk, tables, text
from .cjk import wrap_metric
from .lines import exploded
from .tables import scored, shape, signals


def metrics(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text (Markdown). One row a document."""
    plain = F.regexp_replace("text", r"(?i)<br\s*/?>", "")
    whole = docs.select("doc_id", F.length(plain).cast("long").alias("chars"), F.length(text.without_space(plain)).cast("long").alias("body_chars"), cjk.stats(F.col("text"))["per_1k"].alias("cjk_per_1k"), F.regexp_count("text", F.lit(r"<!--PAGE:\d+-->")).cast("long").alias("anchors"))
    lines = exploded(docs)
    t = text.trim(F.col("line"))
    counted = lines.groupBy("doc_id").agg(F.count_if(tables.sep_metric(F.col("line"))).alias("tables"), F.count_if(t.startswith("|")).alias("table_rows"), F.count_if(F.col("line").rlike(r"\A#{1,6} ")).alias("headings"))
    wraps = wrap_metric(lines).select("doc_id", "wraps", F.col("per_100").alias("wrap_per_100"))
    bad = shape(lines).select("doc_id", F.col("bad_rows").alias("bad_table_rows"))
    score = scored(signals(lines)).select("doc_id", "score")
    return whole.join(counted, "doc_id").join(wraps, "doc_id").join(bad, "doc_id").join(score, "doc_id")


def compared(base: DataFrame, now: DataFrame) -> DataFrame:
    """doc_id, ok, issues (joined): what has become worse. Columns as of metrics()."""
    both = base.select("doc_id", *[F.col(c).alias("b_" + c) for c in base.columns if c != "doc_id"]).join(now, "doc_id")
    b, c = (lambda k: F.col("b_" + k)), F.col
    rules = [("anchors", b("anchors") != c("anchors"))]
    rules += [(k, c(k) < F.floor(b(k) * 0.97)) for k in ("chars", "body_chars")]
    rules += [("cjk_per_1k", (c("cjk_per_1k") > b("cjk_per_1k") * 1.2) & (c("cjk_per_1k") > b("cjk_per_1k") + 1.0))]
    rules += [(k, c(k) < b(k)) for k in ("tables", "table_rows", "headings")]
    rules += [("score", c("score") < b("score") - 2), ("wraps", c("wraps") > b("wraps")), ("bad_table_rows", c("bad_table_rows") > b("bad_table_rows"))]
    issues = F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in rules]))
    return both.select("doc_id", (F.size(issues) == 0).alias("ok"), F.array_join(issues, ",").alias("issues"))
