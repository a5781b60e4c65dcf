"""Boxes, glyphs and rulings of pages. Joins keep (doc_id, page_no) as equal keys; geometry is a condition on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P = ("doc_id", "page_no")


def downscaled(w: Column, h: Column, limit: int) -> tuple[Column, Column]:
    """Width and height with the longer side cut to a limit."""
    ratio = F.lit(float(limit)) / F.greatest(w, h)
    small = lambda x: F.when(F.greatest(w, h) <= limit, x).otherwise(F.greatest(F.lit(1), F.floor(x * ratio)))
    return small(w), small(h)


def area(b: str = "") -> Column:
    c = lambda k: F.col(f"{b}{k}").cast("double")
    return F.greatest(c("x2") - c("x1"), F.lit(0.0)) * F.greatest(c("y2") - c("y1"), F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """Intersection by the smaller area."""
    c = lambda p, k: F.col(f"{p}{k}").cast("double")
    w = F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))
    h = F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1"))
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return F.when(inter > 0, inter / F.greatest(F.least(area(a), area(b)), F.lit(1e-6))).otherwise(0.0)


def _pairs(boxes: DataFrame, a="a_", b="b_"):
    keep = lambda p: boxes.select(*P, *[F.col(c).alias(p + c) for c in boxes.columns if c not in P])
    return keep(a).join(keep(b), list(P)).filter(f"{a}box_id <> {b}box_id")


def contained(boxes: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Boxes that lie within a clearly larger one."""
    inside = (F.col("a_x1") >= F.col("b_x1")) & (F.col("a_y1") >= F.col("b_y1")) & (F.col("a_x2") <= F.col("b_x2")) & (F.col("a_y2") <= F.col("b_y2"))
    hit = _pairs(boxes).filter(inside & (area("a_") < area("b_")) & (area("a_") / area("b_") < ratio))
    return hit.select(*P, F.col("a_box_id").alias("box_id")).distinct()


def suppressed(boxes: DataFrame, limit: float = 0.6) -> DataFrame:
    """Boxes without contained ones and without those that overlap a better scored kept one; a page's boxes are folded by score."""
    left = boxes.join(contained(boxes), [*P, "box_id"], "left_anti")
    fields = ["x1", "y1", "x2", "y2"]
    page = left.groupBy(*P).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "box_id", *[F.col(c).cast("double").alias(c) for c in fields]))).alias("b"))

    def over(a, b):
        w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
        h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
        size = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
        return (w > 0) & (h > 0) & (w * h / F.greatest(F.least(size(a), size(b)), F.lit(1e-6)) > limit)

    kind = "array<struct<s:double,box_id:bigint,x1:double,y1:double,x2:double,y2:double>>"
    kept = F.aggregate(F.col("b").cast(kind), F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda k: over(x, k)), acc).otherwise(F.array_append(acc, x)))
    return page.select(*P, F.explode(F.transform(kept, lambda k: k["box_id"])).alias("box_id"))


def padding(boxes: DataFrame) -> DataFrame:
    """doc_id, page_no, box_id, pad: room around a box, up to its nearest neighbour that does not touch it."""
    c = F.col
    ox, oy = (c("a_x1") < c("b_x2")) & (c("b_x1") < c("a_x2")), (c("a_y1") < c("b_y2")) & (c("b_y1") < c("a_y2"))
    gx, gy = F.least(F.abs(c("a_x1") - c("b_x2")), F.abs(c("b_x1") - c("a_x2"))), F.least(F.abs(c("a_y1") - c("b_y2")), F.abs(c("b_y1") - c("a_y2")))
    gap = F.when(ox & oy, 0).when(ox, gy).when(oy, gx).otherwise(F.least(gx, gy))
    near = _pairs(boxes).withColumn("gap", gap).filter("gap > 0").groupBy(*P, c("a_box_id").alias("box_id")).agg(F.min("gap").alias("gap"))
    own = F.greatest(F.lit(16), F.floor(F.least(c("x2") - c("x1"), c("y2") - c("y1")) * 2))
    return boxes.join(near, [*P, "box_id"], "left").select(*P, "box_id", F.greatest(F.lit(0), F.least(own, F.floor(F.coalesce("gap", own)))).cast("long").alias("pad"))


def clusters(values: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """doc_id, page_no, cluster (from 1), mean (one decimal), n: values v no further apart than the tolerance from one to the next."""
    w = Window.partitionBy(*P).orderBy("v")
    new = F.coalesce(F.col("v") - F.lag("v").over(w) > tolerance, F.lit(True))
    runs = values.withColumn("new", new).withColumn("cluster", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*P, "cluster").agg(F.bround(F.avg("v"), 1).alias("mean"), F.count("*").alias("n"))


def ruled(rulings: DataFrame) -> DataFrame:
    """doc_id, page_no, rows, cols, top, bottom: pages with a grid of thin long segments. rulings: l, b, r, t."""
    w, h = F.col("r") - F.col("l"), F.col("t") - F.col("b")
    flat = rulings.filter((h <= 1.5) & (w >= 4)).select(*P, ((F.col("b") + F.col("t")) / 2).alias("v"))
    steep = rulings.filter((w <= 1.5) & (h >= 4)).select(*P, ((F.col("l") + F.col("r")) / 2).alias("v"))
    rows = clusters(flat).groupBy(*P).agg(F.count("*").alias("hs"), F.max("mean").alias("top"), F.min("mean").alias("bottom"))
    cols = clusters(steep).groupBy(*P).agg(F.count("*").alias("vs"))
    return rows.join(cols, list(P)).filter("hs >= 2 and vs >= 2").select(*P, (F.col("hs") - 1).alias("rows"), (F.col("vs") - 1).alias("cols"), "top", "bottom")


def within(points: DataFrame, boxes: DataFrame, first: bool = False) -> DataFrame:
    """points (doc_id, page_no, point_id, cx, cy) with the box_ids that hold them; first: only the smallest, null for none."""
    hit = points.join(boxes.select(*P, "box_id", "x1", "y1", "x2", "y2"), list(P)).filter("cx >= x1 and cx <= x2 and cy >= y1 and cy <= y2").select(*P, "point_id", "box_id")
    if not first:
        return hit
    return points.select(*P, "point_id").join(hit.groupBy(*P, "point_id").agg(F.min("box_id").alias("box_id")), [*P, "point_id"], "left")


def _in_lines(glyphs: DataFrame, *keys: str, name: str = "row") -> DataFrame:
    """glyphs with the number (from 1) of their line in each group of keys.

    From the top down a line ends where a glyph lies wholly below all before it
    (by one point): an earlier line's lowest edge is above, so the lowest edge of
    the group so far is that of the line.
    """
    w = Window.partitionBy(*P, *keys).orderBy(F.desc("t"), "l", "idx")
    low = F.min("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return glyphs.withColumn("_new", F.coalesce(F.col("t") < low - 1, F.lit(True))).withColumn(name, F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def glyph_rows(glyphs: DataFrame) -> DataFrame:
    """doc_id, page_no, row (from 1), text: glyphs (ch, l, r, b, t, idx) in lines, wide gaps as spaces; blank glyphs do not count. Lines that few tall glyphs bridge are taken apart, the tall ones first."""
    rows = split_bridged(_in_lines(glyphs.filter(~F.col("ch").rlike(r"(?U)\A\s*\z")), name="line"), "line")
    order = Window.partitionBy(*P).orderBy("line", "part")
    return _written(rows.withColumn("row", F.dense_rank().over(order)), "row")


def _written(glyphs: DataFrame, *keys: str) -> DataFrame:
    """Text of each line: real spaces count (one for several), else gaps do."""
    r = Window.partitionBy(*P, *keys).orderBy("l", "idx")
    gap = F.col("l") - F.lag("r").over(r)
    wide = gap > F.greatest(F.lit(2.5), 0.45 * (F.lag("r").over(r) - F.lag("l").over(r)))
    spaced = (F.col("ch") != " ") & (F.lag("ch").over(r) != " ") & wide
    parts = glyphs.withColumn("part", F.concat(F.when(F.coalesce(spaced, F.lit(False)), F.lit(" ")).otherwise(F.lit("")), "ch"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "idx", "part"))), lambda x: x["part"]), "")
    return parts.groupBy(*P, *keys).agg(F.trim(F.regexp_replace(text, " +", " ")).alias("text"))


def glyph_cells(glyphs: DataFrame, bands: DataFrame, cols: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """doc_id, page_no, band, col, text and, with null band or col, glyphs that no cell takes. bands: band, lo, hi; cols: col, lo, hi. The first that fits counts. A cell's lines follow each other with a space; bars are escaped."""

    def place(g, sides, name, at):
        hit = g.join(sides.select(*P, name, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), list(P)).filter((at >= F.col("_lo") - tolerance) & (at <= F.col("_hi") + tolerance))
        return g.join(hit.groupBy(*P, "idx").agg(F.min(name).alias(name)), [*P, "idx"], "left")

    g = place(place(glyphs, bands, "band", (F.col("b") + F.col("t")) / 2), cols, "col", (F.col("l") + F.col("r")) / 2)
    lines = _written(_in_lines(g, "band", "col", name="row"), "band", "col", "row").filter("text <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), " ")
    cells = g.select(*P, "band", "col").distinct()
    found = lines.groupBy(*P, "band", "col").agg(F.replace(text, F.lit("|"), F.lit("\\|")).alias("text"))
    same = [cells[k].eqNullSafe(found[k]) for k in (*P, "band", "col")]
    return cells.join(found, same[0] & same[1] & same[2] & same[3], "left").select(*[cells[k] for k in (*P, "band", "col")], F.coalesce(found["text"], F.lit("")).alias("text"))


def char_pages(boxes: DataFrame) -> DataFrame:
    """doc_id, page_no, char_positioned: pages whose text comes one character a box. boxes: chars, true_chars."""
    s = boxes.groupBy(*P).agg(F.sum("chars").alias("c"), F.count("*").alias("n"), F.max("true_chars").alias("k"))
    return s.select(*P, ((F.col("c") / F.col("n") < 1.5) | (F.col("k") <= 1.2 * F.col("n"))).alias("char_positioned"))


def rebuilt_counts(rebuilt: Column, true_chars: Column) -> Column:
    """A rebuilt page is taken if it has nine tenths of the characters."""
    return rebuilt >= true_chars * 0.9


#: A jump of heights that parts tall glyphs from others, and how many of a line may be tall.
JUMP, MINORITY = 1.5, 0.4


def split_bridged(glyphs: DataFrame, row: str = "row") -> DataFrame:
    """glyphs (row, idx, b, t, ...) with part: lines that few tall glyphs bridge come in parts, the tallest glyphs first.

    Heights count to one decimal. The widest jump between neighbouring heights
    parts a line of three glyphs or more, if the taller ones are a minority; the
    others are looked at again. Each time the heights below the cut remain, so
    a line's cuts are found on its sorted heights alone: no glyph is joined.
    """
    h = F.bround(F.col("t") - F.col("b"), 1)
    state = "struct<left:array<double>,cuts:array<double>,go:boolean>"

    def cut(acc, _):
        left = acc["left"]
        each = F.array_sort(F.array_distinct(F.filter(left, lambda x: x > 0)))
        n = F.size(each)
        jumps = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.struct((F.get(each, i - 1) / F.get(each, i - 2)).alias("jump"), F.get(each, i - 1).alias("at")))
        best = F.array_max(jumps)  # of equal jumps the tallest
        tall = F.size(F.filter(left, lambda x: x >= best["at"]))
        go = acc["go"] & (F.size(left) >= 3) & (n >= 2) & (best["jump"] >= JUMP) & (tall <= MINORITY * F.size(left))
        split = F.struct(F.filter(left, lambda x: x < best["at"]).alias("left"), F.array_append(acc["cuts"], best["at"]).alias("cuts"), F.lit(True).alias("go"))
        return F.when(F.coalesce(go, F.lit(False)), split).otherwise(F.struct(left.alias("left"), acc["cuts"].alias("cuts"), F.lit(False).alias("go"))).cast(state)

    of_row = glyphs.withColumn("_h", h.cast("double")).groupBy(*P, row).agg(F.collect_list("_h").alias("left"))
    steps = F.array_distinct("left")
    first = F.struct(F.col("left"), F.array().cast("array<double>").alias("cuts"), F.lit(True).alias("go")).cast(state)
    cuts = of_row.select(*P, row, F.aggregate(steps, first, cut, lambda a: a["cuts"]).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c > h))
    return glyphs.join(cuts, [*P, row]).withColumn("part", part).drop("_cuts")


def grid(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """doc_id, page_no, row, col, txt: cells (cell_id, x1, y1, x2, y2, txt) in rows cut at the widest gaps, columns by the full rows' centres.

    shape: doc_id, page_no, nrows. Of equal gaps the later is cut. Short rows are
    placed cell by cell at the nearest free column to the right.
    """
    c = cells.withColumn("cx", (F.col("x1") + F.col("x2")) / 2.0).withColumn("cy", (F.col("y1") + F.col("y2")) / 2.0).join(shape, list(P))
    y = Window.partitionBy(*P).orderBy("cy", "cell_id")
    c = c.withColumn("k", F.row_number().over(y)).withColumn("gap", F.lead("cy").over(y) - F.col("cy")).withColumn("n", F.count("*").over(Window.partitionBy(*P)))
    c = c.withColumn("place", F.when(F.col("gap").isNotNull(), F.row_number().over(Window.partitionBy(*P).orderBy(F.desc_nulls_last("gap"), F.desc("k")))))
    cut = F.coalesce((F.col("nrows") >= 2) & (F.col("n") >= F.col("nrows")) & (F.col("place") <= F.col("nrows") - 1), F.lit(False))
    c = c.withColumn("cut", cut).withColumn("row", F.coalesce(F.sum(F.col("cut").cast("int")).over(y.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = Window.partitionBy(*P, "row").orderBy("cx", "k")
    c = c.withColumn("i", F.row_number().over(x) - 1).withColumn("len", F.count("*").over(Window.partitionBy(*P, "row")))
    c = c.withColumn("width", F.max("len").over(Window.partitionBy(*P)))
    slot = c.filter("len = width").groupBy(*P, "i").agg(F.array_sort(F.collect_list("cx")).alias("xs")).select(*P, F.struct("i", F.element_at("xs", (F.floor(F.size("xs") / 2) + 1).cast("int")).alias("cx")).alias("s"))
    slots = slot.groupBy(*P).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["cx"]).alias("slots"))
    rows = c.groupBy(*P, "row", "len", "width").agg(F.array_sort(F.collect_list(F.struct("i", "cx", "txt"))).alias("r")).join(slots, list(P))

    def put(acc, it):
        gaps = F.transform(F.col("slots"), lambda s: F.abs(s - it["cx"]))
        near = F.array_position(gaps, F.array_min(gaps)).cast("int") - 1
        free = F.array_min(F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda j: (j >= near) & (F.element_at(acc, (j + 1).cast("int")) == "")))
        return F.when(free.isNull(), acc).otherwise(F.transform(acc, lambda v, j: F.when(j == free, it["txt"]).otherwise(v)))

    full = F.transform("r", lambda x: x["txt"])
    line = F.when(F.col("len") == F.col("width"), full).otherwise(F.aggregate("r", F.array_repeat(F.lit(""), F.col("width").cast("int")), put))
    return rows.select(*P, F.col("row").cast("long").alias("row"), F.posexplode(line).alias("col", "txt"))


def columns(boxes: DataFrame, pages: DataFrame, bins: int = 1000, full: float = 0.6, gap: float = 0.03) -> DataFrame:
    """boxes with col (from 0) and wide: columns are cut where no narrow box stands, if every column looks like one; else all are column 0.

    pages: doc_id, page_no, page_w. A cut is an empty run of bins, not at an
    edge, of ``gap`` or more; each column needs three narrow boxes over four
    tenths of the height.
    """
    b = boxes.join(pages, list(P)).withColumn("wide", (F.col("x2") - F.col("x1")) >= full * F.col("page_w")).withColumn("all", F.count("*").over(Window.partitionBy(*P)))
    narrow = b.filter("not wide")
    bin_of = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.col(c) / F.col("page_w") * bins).cast("int")))
    covered = narrow.select(*P, F.explode(F.sequence(bin_of("x1"), bin_of("x2"))).alias("bin")).distinct()
    w = Window.partitionBy(*P).orderBy("bin")
    # an empty run lies between two covered bins; at the edges there is none that counts
    runs = covered.withColumn("a", F.lag("bin").over(w) + 1).withColumn("z", F.col("bin") - 1).filter((F.col("z") >= F.col("a")) & (F.col("a") > 5) & (F.col("z") < bins - 6) & ((F.col("z") - F.col("a")) / float(bins) >= gap))
    cuts = runs.groupBy(*P).agg(F.array_sort(F.collect_list((F.col("a") + F.col("z")) / 2.0 / bins)).alias("cuts"))
    some = narrow.groupBy(*P).agg(F.count("*").alias("n"), (F.greatest(F.lit(1), F.max("y2") - F.min("y1"))).alias("height"))
    b = b.join(some, list(P), "left").join(cuts, list(P), "left")
    centre = (F.col("x1") + F.col("x2")) / 2.0 / F.col("page_w")
    col = F.when((F.col("all") >= 4) & (F.col("n") >= 4) & F.col("cuts").isNotNull(), F.when(centre >= 1, 0).otherwise(F.size(F.filter("cuts", lambda c: c <= centre)))).otherwise(0)
    b = b.withColumn("col", col)
    each = b.groupBy(*P, "col").agg(F.count_if(~F.col("wide")).alias("k"), (F.max(F.when(~F.col("wide"), F.col("y2"))) - F.min(F.when(~F.col("wide"), F.col("y1")))).alias("span"), F.max("height").alias("height"))
    good = each.groupBy(*P).agg(F.bool_and((F.col("k") >= 3) & (F.coalesce("span", F.lit(0)) >= 0.4 * F.col("height"))).alias("good"))
    b = b.join(good, list(P))
    cut = F.col("good") & F.col("cuts").isNotNull() & (F.col("n") >= 4) & (F.col("all") >= 4)
    return b.select(*boxes.columns, F.when(cut, F.col("col")).otherwise(0).cast("long").alias("col"), "wide", F.coalesce(cut, F.lit(False)).alias("multi"))


def reading_order(boxes: DataFrame, pages: DataFrame, by_columns: bool = True) -> DataFrame:
    """doc_id, page_no, box_id, place: column by column, full-width boxes before or behind them; by (y, x) on pages of one column."""
    b = columns(boxes, pages)
    body = ~F.col("wide")
    w = Window.partitionBy(*P)
    bottom, some = F.max(F.when(body, F.col("y2"))).over(w), F.max(body.cast("int")).over(w) == 1
    part = F.when(~(F.col("multi") & some & F.lit(by_columns)), 0).when(body, 1).when(F.col("y1") >= bottom, 2).otherwise(0)
    order = Window.partitionBy(*P).orderBy("part", F.when(F.col("part") == 1, F.col("col")).otherwise(0), "y1", "x1", "box_id")
    return b.withColumn("part", part).select(*P, "box_id", F.row_number().over(order).cast("long").alias("place"))


def table_pairs(tables: DataFrame, heights: DataFrame, band: float = 60.0) -> DataFrame:
    """doc_id, page_no, cols: a page's last table that the next page's first seems to go on: near the edges, as many columns."""
    t = tables.join(heights, list(P))
    last = t.groupBy(*P).agg(F.min_by(F.struct("y_bot", "cols"), "y_bot").alias("last"), F.max_by(F.struct("y_top", "cols", "page_h"), "y_top").alias("first"))
    nxt = last.select("doc_id", (F.col("page_no") - 1).alias("page_no"), F.col("first").alias("n"))
    return last.join(nxt, list(P)).filter((F.col("last.y_bot") <= band) & (F.col("n.y_top") >= F.col("n.page_h") - band) & (F.col("last.cols") == F.col("n.cols"))).select(*P, F.col("last.cols").alias("cols"))


def structure(tokens: DataFrame) -> DataFrame:
    """doc_id, page_no, nrows, ncols, route: of a recognised table's tags in order (seq, tag); one column is a text box."""
    t = tokens.withColumn("row", F.sum((F.col("tag") == "<tr>").cast("int")).over(Window.partitionBy(*P).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    each = t.groupBy(*P, "row").agg(F.count_if(F.col("tag").isin("<td></td>", "<td")).alias("cells"), F.count_if(F.col("tag") == "<tr>").alias("rows"))
    s = each.groupBy(*P).agg(F.sum("rows").alias("nrows"), F.max("cells").alias("ncols"))
    return s.withColumn("route", F.when(F.col("ncols") <= 1, "text box").otherwise("table"))


def region_route(label: Column) -> Column:
    """What reads a region."""
    return F.when(label.isin("doc_title", "paragraph_title", "title"), "heading").when(label == "table", "table").when(label.isin("formula", "equation"), "formula").when(label.isin("seal", "stamp"), "stamp").when(label.isin("image", "figure", "chart"), "image").otherwise("text")


def ocr_order(lines: DataFrame, step: float = 8.0) -> DataFrame:
    """lines (idx, x, y) with place: by rounded height, then from the left."""
    w = Window.partitionBy(*P).orderBy(F.bround(F.col("y") / step), "x", "idx")
    return lines.withColumn("place", F.row_number().over(w).cast("long"))


def clamped(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column, least: int = 24) -> Column:
    """A crop within its page, null if too small."""
    box = F.struct(F.greatest(F.least(x1, x2), F.lit(0)).alias("x1"), F.greatest(F.least(y1, y2), F.lit(0)).alias("y1"), F.least(F.greatest(x1, x2), w).alias("x2"), F.least(F.greatest(y1, y2), h).alias("y2"))
    return F.when((box["x2"] - box["x1"] >= least) & (box["y2"] - box["y1"] >= least), box)


def image_ratio(images: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, ratio: images' area by the page's, 1 at most, three decimals."""
    a = images.groupBy(*P).agg(F.sum(area()).alias("a"))
    return pages.join(a, list(P), "left").select(*P, F.bround(F.least(F.coalesce("a", F.lit(0.0)) / (F.col("page_w") * F.col("page_h")), F.lit(1.0)), 3).alias("ratio"))


def figures(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Images worth keeping: neither tiny nor the page itself."""
    share = area() / (F.col("page_w") * F.col("page_h"))
    return images.join(pages, list(P)).filter((share >= 0.02) & (share < 0.9) & (F.col("x2") - F.col("x1") >= 8) & (F.col("y2") - F.col("y1") >= 8)).select(*images.columns)
