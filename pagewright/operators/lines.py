"""Texts as lines and back. Windows run per document over (doc_id, line_no), so that several rules share one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by():
    return Window.partitionBy("doc_id").orderBy("line_no")


def so_far():
    return by().rowsBetween(Window.unboundedPreceding, 0)


def exploded(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no (from 1), line."""
    found = docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    return found.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


def joined(lines: DataFrame, *keys: str, text: str = "line", as_: str = "text", order: str = "line_no", between: str = "\n") -> DataFrame:
    """The lines of each key put together in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("_t"))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["_t"]), between).alias(as_))


def fenced(line: Column, fence: str) -> tuple[Column, Column]:
    """(is a fence, stands inside a fence) of each line; a fence itself is not inside."""
    is_fence = line.rlike(fence)
    return is_fence, ~is_fence & (F.sum(is_fence.cast("int")).over(so_far()) % 2 == 1)


def islands(boundary: Column, window=None) -> Column:
    """Number of the run a row belongs to: a new one starts at each boundary."""
    return F.sum(boundary.cast("int")).over(window or so_far())
