"""Queries of the HTML reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.web import html_text as read_html
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)


@query(None, "pages")
def html_text(pages):
    return read_html(pages).select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href='))::BIGINT AS links FROM pages", "pages")
def html_links(pages):
    return read_html(pages).select("page_id", F.size("links").cast("long").alias("links"))


@query("SELECT page_id, len(regexp_extract_all(html, '<h[1-6]'))::BIGINT AS headings, len(regexp_extract_all(html, '<h1'))::BIGINT AS first_level FROM pages", "pages")
def html_headings(pages):
    return read_html(pages).select("page_id", F.size("headings").cast("long").alias("headings"), F.size(F.filter("headings", lambda h: h["level"] == 1)).cast("long").alias("first_level"))
