"""Table rules over lines: noise rows, shapes, quality signals, tables that go on over page ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cjk, tables
from ..functions.text import half_up, trim
from .lines import by, so_far, islands


def without_noise(lines: DataFrame) -> DataFrame:
    """Rows of blanks and zeros go; counts with doc_noise()."""
    return lines.filter(~tables.noise(F.col("line")))


def doc_noise(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.count_if(tables.noise(F.col("line"))).alias("removed"), F.count("*").alias("lines"))


def shape(lines: DataFrame) -> DataFrame:
    """doc_id, tables, rows, bad_rows: data rows, and those whose width is not their header's."""
    bar = trim(F.col("line")).startswith("|")
    marked = lines.select("doc_id", "line_no", bar.alias("bar"), (bar & tables.sep_shape(F.col("line"))).alias("sep"), tables.width(trim(F.col("line"))).alias("w"))
    runs = marked.withColumn("run", islands(~F.col("bar"))).filter("bar and not sep")
    w = Window.partitionBy("doc_id", "run").orderBy("line_no")
    rows = runs.withColumn("n", F.row_number().over(w)).withColumn("head", F.first("w").over(w))
    found = rows.groupBy("doc_id").agg(F.count_if(F.col("n") == 1).alias("tables"), F.count_if(F.col("n") > 1).alias("rows"), F.count_if((F.col("n") > 1) & (F.col("w") != F.col("head"))).alias("bad_rows"))
    return lines.select("doc_id").distinct().join(found, "doc_id", "left").na.fill(0)


def signals(lines: DataFrame) -> DataFrame:
    """Per document: counts and ratios of tables and lines; ratios are 0 below their smallest sample."""
    line, t = F.col("line"), trim(F.col("line"))
    is_row = tables.row(line) & ~tables.sep_quality(line)
    content = (t != "") & ~t.startswith("|") & ~t.startswith("#") & ~t.startswith("<!--") & ~t.rlike(r"\A(-{3,}|\*{3,})\z")
    marked = lines.select("doc_id", "line_no", is_row.alias("r"), content.alias("c"), (content & (F.length(t) <= 4)).alias("short"), *[F.when(is_row, c).otherwise(0).alias(k) for k, c in zip(("w", "empty"), tables.filled(line))], *[c.alias(k) for k, c in cjk.stats(line).items() if k != "per_1k"])
    last = F.last(F.when(F.col("r"), F.col("w")), ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("jitter", F.col("r") & last.isNotNull() & (last != F.col("w")))
    n = lambda c: F.count_if(c)
    s = marked.groupBy("doc_id").agg(
        n("r").alias("table_rows"), F.sum(F.when(F.col("r"), F.col("w"))).alias("cells"), F.sum("empty").alias("empty"), n(F.col("r") & (F.col("empty") > 0)).alias("with_empty"), n("jitter").alias("jitter"),
        n("c").alias("content_lines"), n("short").alias("short"), F.sum("injected").alias("injected"), F.sum("cjk_chars").alias("cjk_chars"), F.sum("torn_digits").alias("torn_digits"),
    )
    ratio = lambda a, b, least: F.when(F.col(b) >= least, F.col(a).cast("double") / F.col(b)).otherwise(0.0)
    return s.select("doc_id", "table_rows", "content_lines", ratio("with_empty", "table_rows", 4).alias("frag"), ratio("empty", "cells", 1).alias("empty_cells"), ratio("jitter", "table_rows", 4).alias("jitter"), ratio("short", "content_lines", 6).alias("short"), "injected", "cjk_chars", "torn_digits")


def scored(s: DataFrame) -> DataFrame:
    """signals() with score, char_fragmented, suggest_vision, route."""
    fragmented = (F.col("table_rows") >= 4) & (F.col("frag") >= 0.5)
    chars = (F.col("content_lines") >= 20) & (F.col("short") >= 0.9)
    score = 100 - F.when(fragmented, F.least(F.lit(50), half_up((F.col("frag") - 0.3) * 80))).otherwise(0)
    score = F.when(chars, F.least(score, F.lit(20))).otherwise(score)
    score = score - F.when((F.col("jitter") > 0.3) & (F.col("table_rows") >= 4), F.least(F.lit(15), half_up((F.col("jitter") - 0.3) * 40))).otherwise(0)
    two = lambda c: half_up(F.col(c) * 100) / 100.0
    return s.select(
        "doc_id", "table_rows", "content_lines", two("frag").alias("frag"), two("empty_cells").alias("empty_cells"), two("jitter").alias("jitter"), two("short").alias("short"), "injected",
        F.when(F.col("cjk_chars") > 0, half_up(F.col("injected") * 100000.0 / F.col("cjk_chars")) / 100.0).otherwise(0.0).alias("per_1k"), "torn_digits", chars.alias("char_fragmented"),
        F.greatest(score, F.lit(0)).cast("long").alias("score"), (fragmented | chars).alias("suggest_vision"), F.when(chars, "vision: whole document").when(fragmented, "vision: pages concerned").otherwise("text").alias("route"),
    )


def continued(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line: tables that go on over page ends are one.

    Two blocks of table lines are one table if nothing but blank lines and
    anchors stands between them, both have a header, a separator and a row, and
    the widths are equal. Rows of later blocks move behind the first block, a
    repeated header goes, another one counts as a row; separators go. Moved rows
    keep their order through line_no of the first block's end and their own.
    """
    line = F.col("line")
    marked = lines.withColumn("bar", tables.table_line(line)).withColumn("blank", (trim(line) == "") | cjk.anchor(line)).withColumn("block", F.when(F.col("bar"), islands(~F.col("bar"))))
    marked = marked.withColumn("wall", F.sum((~F.col("bar") & ~F.col("blank")).cast("int")).over(so_far()))
    w = Window.partitionBy("doc_id", "block").orderBy("line_no")
    marked = marked.withColumn("n", F.when(F.col("bar"), F.row_number().over(w)))
    each = marked.filter("bar").groupBy("doc_id", "block").agg(
        F.min("line_no").alias("start"), F.max("line_no").alias("end"), F.max("wall").alias("wall"), F.count("*").alias("rows"), F.max(F.when(F.col("n") == 1, line)).alias("head"), F.max(F.when(F.col("n") == 2, tables.sep_scan(line))).alias("ok"), F.max(F.when(F.col("n") == 1, tables.width(line))).alias("width")
    )
    o = Window.partitionBy("doc_id").orderBy("start")
    good = lambda c: c("ok") & (c("rows") >= 3) & (c("width") >= 2)
    own, last = (lambda k: F.col(k)), (lambda k: F.lag(k).over(o))
    chained = F.coalesce(good(own) & good(last) & (last("wall") == F.col("wall")) & (last("width") == F.col("width")), F.lit(False))
    each = each.withColumn("on", chained).withColumn("chain", F.sum((~F.col("on")).cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    c = Window.partitionBy("doc_id", "chain").orderBy("start")
    each = each.withColumn("to", F.first("end").over(c)).withColumn("first_head", F.first("head").over(c)).select("doc_id", "block", "on", "to", (F.col("head") == F.col("first_head")).alias("same"))
    out = marked.join(each, ["doc_id", "block"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    out = out.filter(~(F.col("on") & ((F.col("n") == 2) | ((F.col("n") == 1) & F.col("same")))))
    at = F.when(F.col("on"), F.struct(F.col("to").alias("a"), F.col("line_no").alias("b"))).otherwise(F.struct(F.col("line_no").alias("a"), F.lit(0).cast("long").alias("b")))
    return out.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(at)).cast("long").alias("line_no"), "line")


def noted(before: DataFrame, after: DataFrame, note: str = "<!-- this page continues the table above (merged) -->") -> DataFrame:
    """lines of continued() with a note in pages that lost all they had to it. before, after: doc_id, line_no, line.

    A page stands between its anchors; comments are no content. A page that was
    empty before gets no note. line_no counts anew.
    """
    opens, closes = r"\A<!--PAGE:(\d+)-->\z", r"\A<!--/PAGE:\d+-->\z"

    def paged(lines):
        t = trim(F.col("line"))
        no = F.when(t.rlike(opens), F.regexp_extract(t, opens, 1)).when(F.lag(t).over(by()).rlike(closes), F.lit(""))
        full = (t != "") & ~t.rlike(r"(?s)\A<!--.*-->\z")
        return lines.withColumn("page", F.coalesce(F.last(no, ignorenulls=True).over(so_far()), F.lit(""))).withColumn("full", full).withColumn("edge", t.rlike(opens) | t.rlike(closes))

    filled = lambda x: x.groupBy("doc_id", "page").agg(F.max("full").alias("full")).filter("page <> '' and full").select("doc_id", "page")
    now = paged(after)
    emptied = filled(paged(before)).join(filled(now), ["doc_id", "page"], "left_anti").withColumn("emptied", F.lit(True))
    marked = now.join(emptied, ["doc_id", "page"], "left").filter("emptied is null or edge")
    add = F.when(F.col("emptied") & trim(F.col("line")).rlike(opens), F.array("line", F.lit(""), F.lit(note), F.lit(""))).otherwise(F.array("line"))
    each = marked.select("doc_id", "line_no", F.posexplode(add).alias("i", "line"))
    return each.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "i")).cast("long").alias("line_no"), "line")


def cell_stats(lines: DataFrame) -> DataFrame:
    """doc_id, rows, cols, longest: rows of tables (separators apart), most columns, and the longest cell's characters."""
    body = lines.filter(tables.table_line(F.col("line")) & ~tables.sep_scan(F.col("line"))).withColumn("c", tables.cells(F.col("line")))
    longest = F.array_max(F.transform("c", lambda x: F.length(x)))
    return body.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.size("c")).cast("long").alias("cols"), F.max(longest).cast("long").alias("longest"))


def last_block(lines: Column) -> Column:
    """struct<sep, end, head, last, first, next_head> of the last table of a page's lines, positions from 1; null without a separator."""
    at = F.transform(lines, lambda x, i: F.when(tables.sep_cross(x), i + 1))
    sep = F.array_max(at)

    def walk(acc, i):
        x = F.element_at(lines, i)
        go = acc["go"]
        bar, blank = tables.row(x) & (F.length(trim(x)) > 1), trim(x) == ""
        return F.struct(F.when(go & bar, i).otherwise(acc["end"]).alias("end"), (go & (bar | blank)).alias("go"))

    end = F.when(sep < F.size(lines), F.aggregate(F.sequence(sep + 1, F.size(lines)), F.struct(sep.alias("end"), F.lit(True).alias("go")), walk, lambda a: a["end"])).otherwise(sep)
    above = F.filter(F.slice(lines, 1, sep - 1), lambda x: trim(x) != "")
    head = F.when((F.size(above) > 0) & tables.row(F.element_at(above, -1)), tables.cells(F.element_at(above, -1)))
    first = F.when(sep < F.size(lines), F.element_at(lines, F.least(sep + 1, F.size(lines))))
    return F.when(sep.isNotNull(), F.struct(sep.alias("sep"), end.alias("end"), head.alias("head"), F.element_at(lines, end).alias("last"), first.alias("first")))


def split_rows(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, body, merged: a row that a page end cut in two is whole again, on the earlier page.

    pages: doc_id, page_no, body. Pages are folded per document in order (an
    earlier merge changes what the next test sees), in one aggregate expression;
    a document's pages are the unit, as for any page rule.
    """
    each = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.split("body", "\n", -1).alias("lines"), F.lit(0).alias("merged")))).alias("p"))

    def step(acc, page):
        before = F.element_at(acc, -1)
        pair = F.struct(before.alias("a"), page.alias("b"), last_block(before["lines"]).alias("x"), last_block(page["lines"]).alias("y"))
        both = _let(pair, _merge)
        return F.when(F.size(acc) == 0, F.array(page)).otherwise(_let(both, lambda m: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(m["a"], m["b"]))))

    kind = "array<struct<page_no:bigint,lines:array<string>,merged:int>>"
    folded = each.select("doc_id", F.aggregate(F.col("p").cast(kind), F.array().cast(kind), step).alias("p"))
    return folded.select("doc_id", F.explode("p").alias("x")).select("doc_id", "x.page_no", F.array_join("x.lines", "\n").alias("body"), F.col("x.merged").alias("merged"))


def _let(value, fn):
    return F.element_at(F.transform(F.array(value), fn), 1)


def _merge(p):
    a, b, x, y = p["a"], p["b"], p["x"], p["y"]
    cells = F.struct(tables.cells(x["last"]).alias("l"), tables.cells(y["first"]).alias("r"), F.size(x["head"]).alias("n"))
    plain = lambda h: F.transform(h, lambda s: F.regexp_replace(s, r"(?U)\s+", ""))

    def made(c):
        fits = (b["page_no"] == a["page_no"] + 1) & (c["n"] >= 2) & tables.row(x["last"]) & tables.row(y["first"]) & (F.size(c["l"]) == c["n"]) & (F.size(c["r"]) == c["n"])
        cut = (F.element_at(c["l"], -1) == "") & F.exists(c["l"], lambda s: s != "") & (c["r"][0] == "") & F.exists(c["r"], lambda s: s != "")
        fits = F.coalesce(fits & cut & (plain(x["head"]) == plain(y["head"])), F.lit(False))
        whole = F.zip_with(c["l"], c["r"], lambda u, v: F.when(v == "", u).when(u == "", v).otherwise(F.concat(u, F.lit("<br>"), v)))
        line = F.concat(F.lit("|"), F.array_join(whole, "|"), F.lit("|"))
        a2 = F.struct(a["page_no"].alias("page_no"), F.transform(a["lines"], lambda s, i: F.when(i + 1 == x["end"], line).otherwise(s)).alias("lines"), (a["merged"] + 1).alias("merged"))
        b2 = F.struct(b["page_no"].alias("page_no"), F.concat(F.slice(b["lines"], 1, y["sep"]), F.slice(b["lines"], y["sep"] + 2, F.greatest(F.size(b["lines"]) - y["sep"] - 1, F.lit(0)))).alias("lines"), b["merged"].alias("merged"))
        return F.when(fits, F.struct(a2.alias("a"), b2.alias("b"))).otherwise(F.struct(a.alias("a"), b.alias("b")))

    return _let(cells, made)


def page_source(pages: DataFrame, force_legacy: bool = False) -> DataFrame:
    """Which of two table finders a page takes: pages has primary (tables found), legacy, longest (characters of the primary's longest cell)."""
    legacy = F.lit(force_legacy) | (F.col("primary") == 0) | ((F.col("legacy") > 0) & (F.col("longest") > 200))
    return pages.withColumn("source", F.when((F.col("primary") == 0) & (F.col("legacy") == 0), "none").when(legacy, "legacy").otherwise("primary"))
