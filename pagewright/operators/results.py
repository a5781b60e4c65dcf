"""Results: final documents, slim and canonical rows, page checks of engines, requested pages, crops in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim, without_space
from .lines import joined


def final(docs: DataFrame) -> DataFrame:
    """docs (doc_id, name, chain, md) with document: title, body, and where it comes from; no time stamp, so that it can be compared."""
    tail = F.concat(F.lit("\n\n<!-- source: "), F.col("name"), F.lit(" | chain: "), F.col("chain"), F.lit(" -->\n"))
    return docs.withColumn("document", F.concat(F.lit("# "), F.regexp_replace("name", r"(?<=.)\.[^.]*\z", ""), F.lit("\n\n"), trim(F.col("md")), tail))


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, result: one JSON object with the text's length in the place of the text; nulls are left out."""
    rest = [c for c in docs.columns if c not in ("doc_id", "md")]
    return docs.select("doc_id", F.to_json(F.struct(*rest, F.length("md").alias("mdChars"))).alias("result"))


def canonical(docs: DataFrame) -> DataFrame:
    """docs (doc_id, name, md, code, warnings) -> doc_id, ok, code, md, n_warnings: a failure has a code and no text."""
    ok = F.col("code").isNull() & F.col("md").isNotNull()
    return docs.select("doc_id", ok.alias("ok"), F.when(~ok, F.coalesce("code", F.lit("E_UNKNOWN"))).alias("code"), F.when(ok, F.col("md")).alias("md"), F.size(F.coalesce("warnings", F.array().cast("array<string>"))).cast("long").alias("n_warnings"))


def strip_keys(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, page_no, body, removed: page texts without lines whose text, spaces left out, is a key of the page. lines: doc_id, page_no, line_no, txt."""
    hit = keys.select("doc_id", "page_no", "key").distinct().withColumn("hit", F.lit(1))
    marked = lines.withColumn("key", without_space(F.col("txt"))).join(hit, ["doc_id", "page_no", "key"], "left")
    body = joined(marked.withColumn("kept", F.when(F.col("hit").isNull(), F.col("txt"))).filter("kept is not null"), "doc_id", "page_no", text="kept", as_="body")
    n = marked.groupBy("doc_id", "page_no").agg(F.count("hit").alias("removed"))
    return n.join(body, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("body", F.lit("")).alias("body"), "removed")


def engine_pages(found: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, pages, expected, ok: an engine's pages keep their numbers; another number of pages than asked for is refused."""
    n = found.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages"), F.max("page_no").alias("last"))
    both = expected.join(n, "doc_id", "left").select("doc_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.col("expected"))
    return both.withColumn("ok", F.col("pages") == F.col("expected"))


def requested(wanted: DataFrame, rendered: DataFrame) -> DataFrame:
    """Requested pages that there is a picture of."""
    return wanted.join(rendered.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi")


def page_of(name: Column) -> Column:
    """The page that a picture's name starts or ends with: 003-fig.png, p-03.png."""
    front, back = F.regexp_extract(name, r"\A0*(\d{1,9})(?=\D)", 1), F.regexp_extract(name, r"\Ap-0*(\d{1,9})\.", 1)
    return F.when(back != "", back).when(front != "", front).cast("long")


def brief(hints: DataFrame, size: int = 8) -> DataFrame:
    """Batches of the pages that hints name; none without hints."""
    from .assembly import batched

    return batched(hints.filter("hint").select("doc_id", "page_no"), size)


def rewrite_crops(pages: DataFrame, crops: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, body) with crop references as picture links, rejected ones as comments. crops: doc_id, page_no, ref, file (null: rejected)."""
    each = crops.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("ref", F.coalesce(F.concat(F.lit("![]("), F.col("file"), F.lit(")")), F.lit("<!-- crop rejected -->")).alias("new")))).alias("c"))
    out = F.aggregate(F.coalesce("c", F.array().cast("array<struct<ref:string,new:string>>")), F.col("body"), lambda acc, x: F.replace(acc, x["ref"], x["new"]))
    return pages.join(each, ["doc_id", "page_no"], "left").select("doc_id", "page_no", out.alias("body"))


#: How much evidence of a kind is kept.
CAPS = {"hits": 50, "bad_pages": 8, "patterns": 12, "links": 128, "objects": 4096, "page_chars": 50_000, "cell_chars": 20_000, "crops": 200}


def capped(evidence: Column, kind: str) -> Column:
    """The first items of an array, or characters of a text, that count as evidence of a kind."""
    return F.left(evidence, F.lit(CAPS[kind])) if kind.endswith("_chars") else F.slice(evidence, 1, CAPS[kind])


def all_warnings(before: Column, after: Column) -> Column:
    """Both lists one after the other; a missing one is empty, and nothing is merged."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(before, empty), F.coalesce(after, empty))


def notes(facts: DataFrame) -> DataFrame:
    """doc_id, notes: a map with the sum of each further column of facts, nulls as 0."""
    names = [c for c in facts.columns if c != "doc_id"]
    sums = facts.groupBy("doc_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    return sums.select("doc_id", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names)).alias("notes"))
