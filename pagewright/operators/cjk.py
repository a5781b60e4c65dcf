"""Line rules for ideographic text over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cjk
from ..functions.text import trim
from .lines import by, so_far, fenced, islands


def collapse_spaces(lines: DataFrame) -> DataFrame:
    """lines with out (clean), br_tags, removed, protected; fenced lines stay."""
    fence, inside = fenced(F.col("line"), cjk.FENCE)
    kept = lines.withColumn("protected", fence | inside)
    tags, gaps = cjk.collapsed(F.col("line"))
    free = ~F.col("protected")
    return kept.withColumn("out", F.when(free, cjk.collapse(F.col("line"))).otherwise(F.col("line"))).withColumn("br_tags", F.when(free, tags).otherwise(0)).withColumn("removed", F.when(free, gaps).otherwise(0))


def join_wrapped(lines: DataFrame) -> DataFrame:
    """doc_id, line_no (of the first), line, joined: lines that layout broke within a word are one again.

    Whether a line goes on is a matter of it and its original neighbour, so the
    runs are islands between lines that do not; line_no of the first remains.
    """
    # a line inside a fence, or one that opens it, is never joined; one that closes it may not be either
    count = F.sum(F.col("line").rlike(cjk.FENCE).cast("int")).over(so_far())
    before = F.lag("line").over(by())
    flagged = lines.withColumn("on", F.coalesce(before.isNotNull() & (count % 2 == 0) & cjk.goes_on(before, F.col("line")), F.lit(False)))
    runs = flagged.withColumn("run", islands(~F.col("on"))).withColumn("next_on", F.coalesce(F.lead("on").over(by()), F.lit(False)))
    part = F.when(F.col("on") & F.col("next_on"), trim(F.col("line"))).when(F.col("on"), F.regexp_replace("line", r"(?U)\A\s+", "")).when(F.col("next_on"), F.regexp_replace("line", r"(?U)\s+\z", "")).otherwise(F.col("line"))
    whole = runs.withColumn("part", part).groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "part"))).alias("p"), (F.count("*") - 1).alias("joined"))
    return whole.select("doc_id", "line_no", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("line"), "joined")


def wrap_metric(lines: DataFrame) -> DataFrame:
    """doc_id, wraps, body_lines, per_100."""
    t, nxt = trim(F.col("line")), trim(F.lead("line").over(by()))
    shape = r"\A\s*(\||#{1,6}\s|>|<!-|[-*+]\s|[-=*_]{3,}\s*\z)"
    body = (t != "") & ~t.rlike(r"\A(<!--|\||#)")
    wrap = body & (nxt != "") & ~F.col("line").rlike(shape) & ~F.lead("line").over(by()).rlike(shape) & t.rlike(f"[{cjk.IDEOGRAPH}]\\z") & nxt.rlike(f"\\A[{cjk.IDEOGRAPH}]")
    marked = lines.select("doc_id", body.alias("body"), F.coalesce(wrap, F.lit(False)).alias("wrap"))
    out = marked.groupBy("doc_id").agg(F.count_if("wrap").alias("wraps"), F.count_if("body").alias("body_lines"))
    return out.withColumn("per_100", F.when(F.col("body_lines") > 0, F.floor(F.col("wraps") * 10000.0 / F.col("body_lines") + 0.5) / 100.0).otherwise(0.0))
