"""Pages of batches put together: owners, coverage, findings, subsets, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text
from .lines import joined

SEVERITY = {"blocker": 4, "high": 3, "medium": 2, "low": 1}
SHORT = 10


def assembled(pages: DataFrame, title: bool = True) -> DataFrame:
    """doc_id, md: page blocks in order, the document's name in front."""
    blocks = pages.select("doc_id", "page_no", P.anchored(F.col("page_no"), F.col("body")).alias("block"))
    md = joined(blocks, "doc_id", text="block", as_="md", order="page_no", between="\n\n")
    return md.withColumn("md", F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("md"))) if title else md


#: Stands for a page that no output has.
MISSING = "<!-- page %d is missing: see the findings -->"


def assembled_whole(pages: DataFrame, wanted: DataFrame, title: bool = True) -> DataFrame:
    """As assembled(), over the wanted pages (doc_id, page_no): a missing one has a block that says so."""
    have = pages.select("doc_id", "page_no", F.col("body"), F.lit(True).alias("here"))
    every = wanted.select("doc_id", "page_no").distinct().join(have, ["doc_id", "page_no"], "left")
    body = F.when(F.col("here"), F.col("body")).otherwise(F.format_string(MISSING, "page_no"))
    return assembled(every.select("doc_id", "page_no", body.alias("body")), title)


def page_count(pages: DataFrame) -> DataFrame:
    """doc_id, pages: the highest page number of each document."""
    return pages.groupBy("doc_id").agg(F.max("page_no").alias("pages"))


def first_pages(pages: DataFrame, n: int) -> DataFrame:
    """The first n pages of each document; 0: all."""
    return pages.filter(F.col("page_no") <= n) if n > 0 else pages


def parsed(docs: DataFrame, md: str = "md") -> DataFrame:
    """doc_id, page_no, body: page blocks read from a text; of several with one number the last counts."""
    each = docs.select("doc_id", F.posexplode(P.blocks(F.col(md))).alias("seq", "b"))
    return each.groupBy("doc_id", F.col("b.page_no").alias("page_no")).agg(F.max_by("b.body", "seq").alias("body"))


def owners(plan: DataFrame) -> DataFrame:
    """plan (doc_id, page_no, batch, ...): the batch that first claims a page."""
    return plan.groupBy("doc_id", "page_no").agg(F.min("batch").alias("owner"))


def coverage(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, found, total."""
    have = found.select("doc_id", "page_no").distinct().withColumn("here", F.lit(1))
    return wanted.select("doc_id", "page_no").distinct().join(have, ["doc_id", "page_no"], "left").groupBy("doc_id").agg(F.count("here").alias("found"), F.count("*").alias("total"))


def missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    return wanted.join(found, ["doc_id", "page_no"], "left_anti")


def duplicates(blocks: DataFrame) -> DataFrame:
    """doc_id, batch, page_no, times, body (of the first): numbers that occur more than once in a batch's output. blocks has seq."""
    return blocks.groupBy("doc_id", "batch", "page_no").agg(F.count("*").alias("times"), F.min_by("body", "seq").alias("body")).filter("times > 1")


def foreign(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """Blocks in the output of a batch that does not own their page; owner is null for pages that nobody owns."""
    return blocks.select("doc_id", "batch", "page_no").distinct().join(owners(plan), ["doc_id", "page_no"], "left").filter(~F.col("owner").eqNullSafe(F.col("batch")))


def first_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "page_no").agg(F.min_by("body", F.struct("batch", "seq")).alias("body"))


def findings(blocks: DataFrame, plan: DataFrame, outputs: DataFrame) -> DataFrame:
    """doc_id, page_no, severity, problem, evidence.

    blocks: doc_id, batch, seq, page_no, body. plan: doc_id, page_no, batch.
    outputs: doc_id, batch, state (unspecified, missing, empty, not utf-8, ok):
    pages of a broken batch are reported once, with it.
    """
    kind = "doc_id long, page_no long, severity string, problem string, evidence string"
    of = lambda df, page, severity, problem, evidence: df.select("doc_id", page.cast("long").alias("page_no"), F.lit(severity).alias("severity"), problem.alias("problem"), evidence.cast("string").alias("evidence"))
    first = plan.groupBy("doc_id", "batch").agg(F.min("page_no").alias("page_no"))
    broken = outputs.filter("state <> 'ok'")
    bad = broken.join(first, ["doc_id", "batch"], "left")
    out = of(bad.filter("state <> 'not utf-8'"), F.col("page_no"), "high", F.concat(F.lit("output "), F.col("state")), F.col("batch"))
    out = out.unionByName(of(bad.filter("state = 'not utf-8'"), F.lit(None), "blocker", F.lit("output not utf-8"), F.col("batch")))
    good = blocks.join(broken.select("doc_id", "batch"), ["doc_id", "batch"], "left_anti")
    out = out.unionByName(of(foreign(good, plan), F.col("page_no"), "medium", F.lit("foreign anchor"), F.col("batch")))
    out = out.unionByName(of(duplicates(good), F.col("page_no"), "high", F.lit("duplicate anchor"), F.col("times")))
    kept = first_blocks(good)
    lost = missing(owners(plan), kept).join(broken.select("doc_id", F.col("batch").alias("owner")), ["doc_id", "owner"], "left_anti")
    out = out.unionByName(of(lost, F.col("page_no"), "high", F.lit("missing page"), F.col("owner")))
    length = text.visible_length(F.col("body"))
    out = out.unionByName(of(kept.filter(length < SHORT), F.col("page_no"), "medium", F.lit("very short page"), length))
    hits = sum((c for c in text.mojibake(F.col("body")).values()), F.lit(0))
    out = out.unionByName(of(kept.withColumn("hits", hits).filter("hits > 0"), F.col("page_no"), "medium", F.lit("mojibake"), F.col("hits")))
    assert out.schema.simpleString() == f"struct<{kind.replace('long', 'bigint').replace(', ', ',').replace(' ', ':')}>"
    return out


def ranked(found: DataFrame) -> DataFrame:
    """findings() with their order in a report: by page, those without one first, the gravest first."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("severity")]
    return found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("page_no", F.lit(-1)), rank.desc(), "problem", "evidence")))


def review(found: DataFrame, plan: DataFrame) -> DataFrame:
    """Batches with a grave or middling finding on one of their pages: doc_id, batch, pages, output."""
    suspicious = found.filter("severity in ('high', 'medium') and page_no is not null").select("doc_id", "page_no").distinct()
    hit = plan.join(suspicious, ["doc_id", "page_no"], "left_semi")
    pages = F.array_join(F.array_sort(F.collect_set("page_no")), ",")
    return hit.groupBy("doc_id", "batch").agg(pages.alias("pages")).withColumn("output", F.format_string("review/%d-%03d.md", "doc_id", "batch"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, page_no, body: new blocks in the place of old ones with the same number, others stay."""
    both = old.select("doc_id", "page_no", F.col("body").alias("old")).join(new.select("doc_id", "page_no", F.col("body").alias("new")), ["doc_id", "page_no"], "full")
    return both.select("doc_id", "page_no", F.coalesce("new", "old").alias("body"))


def batched(pages: DataFrame, size: int = 8) -> DataFrame:
    """doc_id, batch (from 1), pages, output: size pages each, in order."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    numbered = pages.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long") + 1)
    out = numbered.groupBy("doc_id", "batch").agg(F.array_join(F.array_sort(F.collect_list("page_no")), ",").alias("pages"))
    return out.withColumn("output", F.format_string("batch-%d-%03d.md", "doc_id", "batch"))


def with_figures(pages: DataFrame, images: DataFrame) -> DataFrame:
    """pages with the images of each page named at the end of its body, unless the first is there already. images: doc_id, page_no, seq, file."""
    each = images.groupBy("doc_id", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "file"))), lambda x: x["file"]).alias("files"))
    links = F.array_join(F.transform("files", lambda f: F.concat(F.lit("![]("), f, F.lit(")"))), "\n")
    add = F.col("files").isNotNull() & (F.instr("body", F.element_at("files", 1)) == 0)
    return pages.join(each, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.when(add, F.concat("body", F.lit("\n\n"), links)).otherwise(F.col("body")).alias("body"))


def figure_references(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, path, first: image references to files of our own."""
    refs = pages.select("doc_id", "page_no", F.posexplode(F.regexp_extract_all("body", F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))).alias("i", "path"))
    return refs.filter(~F.col("path").rlike(r"\A(?i:https?:|data:)")).groupBy("doc_id", "page_no", "path").agg(F.min("i").alias("first"))


def missing_figures(pages: DataFrame, files: DataFrame) -> DataFrame:
    """One finding for each path of a document that no file has. files: doc_id, path."""
    lost = figure_references(pages).join(files, ["doc_id", "path"], "left_anti")
    return lost.groupBy("doc_id", "path").agg(F.min("page_no").alias("page_no")).select("doc_id", "page_no", "path", F.lit("E_FIGURE_MISSING").alias("code"))


def vision_hints(pages: DataFrame, least: float = 0.15) -> DataFrame:
    """doc_id, message: pages that are mostly image, with their share. pages: doc_id, page_no, ratio."""
    hit = pages.filter(F.col("ratio") >= least)
    part = F.format_string("p%d (%.1f%%)", "page_no", F.col("ratio") * 100)
    return hit.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", part.alias("t")))), lambda x: x["t"]), ", ").alias("message"))


def crop_plan(requests: DataFrame, per_page: int = 4) -> DataFrame:
    """requests (doc_id, page_no, seq, x1, y1, x2, y2) with state (accepted, repeated, degenerate, over limit) and id.

    Degenerate boxes count for nothing. A box that an accepted one repeats is
    repeated. Any other counts towards the page's limit; beyond it boxes are
    rejected and not remembered, so that one that comes back is rejected again.
    """
    box = ["x1", "y1", "x2", "y2"]
    good = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    page = Window.partitionBy("doc_id", "page_no").orderBy("seq")
    marked = requests.withColumn("good", good).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page_no", "good", *box).orderBy("seq")))
    # the first of its box has rank r among such firsts; accepted if r is within the limit, and then all later ones repeat it
    marked = marked.withColumn("r", F.sum((F.col("good") & (F.col("n") == 1)).cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.min(F.when(F.col("n") == 1, F.col("r"))).over(Window.partitionBy("doc_id", "page_no", "good", *box))
    state = F.when(~F.col("good"), "degenerate").when(own > per_page, "over limit").when(F.col("n") > 1, "repeated").otherwise("accepted")
    out = marked.withColumn("state", state)
    ident = F.when(F.col("state") == "accepted", F.sum((F.col("state") == "accepted").cast("int")).over(Window.partitionBy("doc_id").orderBy("page_no", "seq").rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("id", ident.cast("long")).select(*requests.columns, "state", "id")
