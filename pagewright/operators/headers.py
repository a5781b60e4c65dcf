"""Running headers and footers, orphaned markers, headings by height, tables between lines.

lines: doc_id, page_no, line_no, yb, yt, txt (points, y upwards); pages with page_h.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import without_space

MARGIN, REPEAT = 0.12, 0.6
#: Lines that count as running ones wherever they stand in the margin.
RUNNING = r"(?i)\A\s*(?:(?:copyright|©|\(c\)).*|\d{1,4}(?:\s*/\s*\d{1,4})?|page\s+\d+(?:\s+of\s+\d+)?|powered by .*)\s*\z"
#: The same for a line's text without white space, as page tools give it.
RUNNING_KEY = r"(?i)\A(?:\u7248\u6743\u6240\u6709.*|\d+(?:/\d+)?|\u7b2c\d+\u9875(?:.*\u5171\d+\u9875)?|poweredby.+)\z"
BULLET, NUMBER = r"\A\s*[•●○▪■◦·\-*]\s*\z", r"\A\s*(\d{1,3}[.、)]?)\s*\z"


def zoned(lines: DataFrame, margin: float = MARGIN) -> DataFrame:
    """lines with zone: top, bottom or null; the top is tried first."""
    zone = F.when(F.col("page_h") <= 0, None).when(F.col("yt") >= F.col("page_h") * (1 - margin), "top").when(F.col("yb") <= F.col("page_h") * margin, "bottom")
    return lines.withColumn("zone", zone)


def threshold(pages, ratio: float = REPEAT):
    return F.greatest(F.lit(2), F.ceil(pages * ratio))


def geometric(lines: DataFrame, margin: float = MARGIN) -> DataFrame:
    """doc_id, key: texts that stand in one margin on many pages (each occurrence counts), or look like running lines."""
    z = zoned(lines, margin).withColumn("key", without_space(F.col("txt")))
    pages = z.filter("page_h > 0").groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    often = z.filter("zone is not null").groupBy("doc_id", "zone", "key").agg(F.count("*").alias("n")).join(pages, "doc_id").filter(F.col("n") >= threshold(F.col("pages")))
    shaped = z.filter("zone is not null").filter(F.col("txt").rlike(RUNNING))
    return often.select("doc_id", "key").unionByName(shaped.select("doc_id", "key")).distinct()


def stripped(lines: DataFrame, keys: DataFrame, margin: float = MARGIN) -> DataFrame:
    """lines without those in a margin whose text is a key; a page that would lose everything keeps it."""
    z = zoned(lines, margin).withColumn("key", without_space(F.col("txt"))).join(keys.withColumn("hit", F.lit(True)), ["doc_id", "key"], "left")
    goes = F.coalesce(F.col("hit"), F.lit(False)) & F.col("zone").isNotNull()
    left = F.sum((~goes).cast("int")).over(Window.partitionBy("doc_id", "page_no"))
    return z.withColumn("goes", goes & (left > 0)).filter("not goes").select(*lines.columns)


def by_page(lines: DataFrame, edge: int = 1) -> DataFrame:
    """doc_id, page_no, key: a first or last line that many pages share (distinct pages count) or that looks like a running line, where the page's body does not have it too. lines: doc_id, page_no, line_no, txt."""
    last = F.max("line_no").over(Window.partitionBy("doc_id", "page_no"))
    z = lines.withColumn("key", without_space(F.col("txt"))).withColumn("band", (F.col("line_no") <= edge) | (F.col("line_no") > last - edge)).filter("key <> ''")
    band = z.filter("band").select("doc_id", "page_no", "key").distinct()
    pages = band.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    often = band.groupBy("doc_id", "key").agg(F.count("*").alias("n")).join(pages, "doc_id").filter(F.col("n") >= threshold(F.col("pages"))).select("doc_id", "key")
    often = often.unionByName(band.filter(F.col("key").rlike(RUNNING_KEY)).select("doc_id", "key")).distinct()
    body = z.filter("not band").select("doc_id", "page_no", "key").distinct()
    return band.join(often, ["doc_id", "key"]).join(body, ["doc_id", "page_no", "key"], "left_anti").select("doc_id", "page_no", "key")


def body_height(lines: DataFrame) -> DataFrame:
    """doc_id, body_h: the most frequent line height in steps of half a point; of equal ones that seen first."""
    h = F.bround(F.col("yt") - F.col("yb"), 1)
    bins = lines.withColumn("h", h).filter("h > 0").select("doc_id", F.struct("page_no", "line_no").alias("at"), (F.bround(F.col("h") * 2) / 2).alias("bin"))
    each = bins.groupBy("doc_id", "bin").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    best = F.max_by("bin", F.struct("n", (-F.col("first.page_no")).alias("p"), (-F.col("first.line_no")).alias("l")))
    return each.groupBy("doc_id").agg(best.alias("body_h"))


def orphans(lines: DataFrame) -> DataFrame:
    """lines with markers put before the line they belong to; markers before markers, and at a page's end, go. Text in txt."""
    bullet, number = F.col("txt").rlike(BULLET), F.regexp_extract("txt", NUMBER, 1)
    m = lines.withColumn("marker", F.when(bullet, "-").when(number != "", F.when(number.rlike(r"[.、]\z"), number).otherwise(F.concat(number, F.lit(".")))))
    m = m.withColumn("own", F.lag("marker").over(Window.partitionBy("doc_id", "page_no").orderBy("line_no")))
    return m.filter("marker is null").select(*[F.when(F.col("own").isNotNull(), F.concat("own", F.lit(" "), "txt")).otherwise(F.col("txt")).alias("txt") if c == "txt" else c for c in lines.columns])


def headings(lines: DataFrame, body: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, txt, level: tall short lines become headings together with what continues them.

    What belongs to a heading depends on the group so far, so each page's lines
    are folded in order; one page's lines are the unit.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int64()), ("line_no", pa.int64()), ("txt", pa.string()), ("level", pa.int32())])
    stop = tuple("。；,;:")

    def fold(rows, unit):
        out, group = [], []

        def close():
            if group:
                level = 2 if max(g[3] for g in group if g[4]) >= 1.40 * unit else 3
                out.append((group[0][0], "#" * level + " " + " ".join(g[1] for g in group), level))
                group.clear()

        for no, txt, yb, yt in rows:
            h = yt - yb
            tall = unit > 0 and h >= 1.25 * unit and 2 <= len(txt) <= 50 and not txt.endswith(stop)
            if group:
                gap = group[-1][2] - yt
                if tall and gap <= 2.2 * unit:
                    group.append((no, txt, yb, h, True))
                    continue
                if not tall and gap <= 0.5 * unit and h >= 0.9 * unit and len(txt) <= 50 and not txt.endswith(stop):
                    group.append((no, txt, yb, h, False))
                    continue
                close()
            if tall:
                group.append((no, txt, yb, h, True))
            else:
                out.append((no, txt, None))
        close()
        return out

    def run(it):
        for batch in it:
            rows = [(d, p, *r) for d, p, unit, ls in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "page_no", "body_h", "lines"))) for r in fold([(x["line_no"], x["txt"], x["yb"], x["yt"]) for x in ls], unit or 0.0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)

    pages = lines.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "txt", F.col("yb").cast("double").alias("yb"), F.col("yt").cast("double").alias("yt")))).alias("lines"))
    return pages.join(body, "doc_id", "left").select("doc_id", "page_no", F.col("body_h").cast("double").alias("body_h"), "lines").mapInArrow(run, "doc_id long, page_no long, line_no long, txt string, level int")


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines whose centre lies in no table of their page. tables: doc_id, page_no, y_bot, y_top."""
    spans = tables.select("doc_id", "page_no", "y_bot", "y_top")
    centre = (lines["yb"] + lines["yt"]) / 2
    on = (lines["doc_id"] == spans["doc_id"]) & (lines["page_no"] == spans["page_no"]) & (centre >= spans["y_bot"]) & (centre <= spans["y_top"])
    return lines.join(spans, on, "left_anti")


def interleaved(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page_no, place, txt: each table comes before the first line that is lower than its top, tables by descending top."""
    t = tables.select("doc_id", "page_no", "y_top", "table_no", "md")
    low = t.join(lines.select("doc_id", "page_no", "line_no", "yt"), ["doc_id", "page_no"]).filter("yt < y_top").groupBy("doc_id", "page_no", "table_no").agg(F.min("line_no").alias("slot"))
    slots = t.join(low, ["doc_id", "page_no", "table_no"], "left").withColumn("slot", F.coalesce("slot", F.lit(2**62)))
    order = Window.partitionBy("doc_id", "page_no").orderBy(F.desc("y_top"), "table_no")
    slots = slots.withColumn("n", F.row_number().over(order)).withColumn("slot", F.max("slot").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a slot never comes before an earlier table's
    both = slots.select("doc_id", "page_no", F.struct("slot", F.lit(0).alias("kind"), "n").alias("at"), F.col("md").alias("txt")).unionByName(lines.select("doc_id", "page_no", F.struct(F.col("line_no").alias("slot"), F.lit(1).alias("kind"), F.lit(0).alias("n")).alias("at"), "txt"))
    return both.select("doc_id", "page_no", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("at")).cast("long").alias("place"), "txt")
