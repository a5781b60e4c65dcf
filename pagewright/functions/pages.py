"""Page numbers and anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim


def number(no: Column) -> Column:
    """Two digits at least; more are never cut."""
    return F.format_string("%02d", no)


def anchored(no: Column, body: Column) -> Column:
    """A page block: the body between its anchors, or the anchors alone."""
    body = trim(F.coalesce(body, F.lit("")))
    return F.concat(F.lit("<!--PAGE:"), number(no), F.lit("-->\n\n"), F.when(body == "", "").otherwise(F.concat(body, F.lit("\n\n"))), F.lit("<!--/PAGE:"), number(no), F.lit("-->"))


def failed_block(no: Column, error: Column) -> Column:
    """A page that could not be read: the message cannot end the comment and is cut at 120 characters."""
    return anchored(no, F.concat(F.lit("<!-- page "), no.cast("string"), F.lit(" failed: "), F.left(F.replace(error, F.lit("--"), F.lit("")), F.lit(120)), F.lit(" -->")))


def blocks(md: Column) -> Column:
    """array<struct<page_no, body>> of a text's page blocks, in order of position."""
    pattern = r"(?s)<!--PAGE:(\d+)-->(.*?)<!--/PAGE:\1-->"
    return F.transform(F.arrays_zip(F.regexp_extract_all(md, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(md, F.lit(pattern), F.lit(2)).alias("b")), lambda x: F.struct(x["n"].cast("long").alias("page_no"), trim(x["b"]).alias("body")))


def spec_error(spec: Column, total: Column) -> Column:
    """Null for a good page specification, else which of its five faults it has."""
    parts = F.filter(F.transform(F.split(spec, ","), trim), lambda x: x != "")
    known = F.forall(parts, lambda x: x.rlike(r"\A\d+(\s*-\s*\d+)?\z"))
    low = lambda x: F.regexp_extract(x, r"\A(\d+)", 1).cast("long")
    high = lambda x: F.regexp_extract(x, r"(\d+)\z", 1).cast("long")
    return (
        F.when(trim(spec) == "", None)
        .when(~known, "not understood")
        .when(F.size(parts) == 0, "empty")
        .when(F.exists(parts, lambda x: (low(x) < 1) | (high(x) < 1)), "pages start at 1")
        .when(F.exists(parts, lambda x: low(x) > high(x)), "range upside down")
        .when((total > 0) & F.exists(parts, lambda x: high(x) > total), "beyond the last page")
    )


def spec_pages(spec: Column, total: Column, mode: str = "strict") -> Column:
    """Sorted page numbers; null means all pages. strict: null if there is a fault; lenient: what is understood, null if nothing; clamp: within 1 .. total."""
    parts = F.filter(F.transform(F.split(spec, ","), trim), lambda x: x.rlike(r"\A\d{1,9}(\s*-\s*\d{1,9})?\z"))
    low = lambda x: F.regexp_extract(x, r"\A(\d+)", 1).cast("long")
    high = lambda x: F.regexp_extract(x, r"(\d+)\z", 1).cast("long")
    right = F.filter(parts, lambda x: low(x) <= high(x))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(right, lambda x: F.sequence(low(x), high(x))))))
    if mode == "strict":
        return F.when(spec_error(spec, total).isNull() & (trim(spec) != ""), pages)
    within = F.filter(pages, lambda p: (p >= 1) & ((total <= 0) | (p <= total)))
    return F.when(F.size(within) > 0, within) if mode == "lenient" else within


def is_prefix(pages: Column) -> Column:
    """Whether pages are 1 .. n."""
    return pages == F.sequence(F.lit(1).cast("long"), F.size(pages).cast("long"))
