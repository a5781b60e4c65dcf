"""Streams give what a table gives, in any order of arrival; rules with state agree with plain folds; rules applied twice change nothing."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import cjk as K
from pagewright.operators import assembly, cjk, geometry, headers, tables
from pagewright.plans.flow import Flow
from pagewright.streaming import events

IDEO = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_the_table(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [{"seq": s, "event": "page", "no": rng.randrange(1, 9), "stats": {"status": rng.choice(["done", "failed"])}, "duration": 1.5, "md": "中 文"} for s in range(60)]
    rng.shuffle(rows)
    lines = [json.dumps(r) for r in rows] + ["not json", "[1]", '{"seq": 3}', json.dumps(rows[0])]
    for i in range(0, len(lines), 16):
        (tmp_path / f"f{i}.json").write_text("\n".join(lines[i : i + 16]))
    shaped = lambda e: e.select(F.lit(1).alias("doc_id"), F.col("no").alias("page_no"), "seq", F.col("stats.status").alias("status"), "duration")
    stream = shaped(events.cleaned(events.read_stream(spark, str(tmp_path), 2)))
    q = events.upsert(stream, f"latest_{seed}", str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    got = {(r.page_no, r.seq, r.status, r.warning) for r in spark.table(f"latest_{seed}").collect()}
    last = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        last[r["no"]] = (r["no"], r["seq"], r["stats"]["status"], None if r["stats"]["status"] == "done" else "failed")
    assert got == set(last.values())


STARTS = ("|", ">", "<!--", "`", "~~~")


def standing_alone(text):
    """Whether a line is layout of its own: it is never joined with another."""
    t = text.strip()
    word, _, rest = t.partition(" ")
    if t.startswith(STARTS) or t == ":" or (len(t) >= 3 and set(t) <= set("-=*_")):
        return True
    if not text.lstrip()[len(word) :][:1].isspace():
        return False
    if word in ("-", "*", "+") or (set(word) == {"#"} and len(word) <= 6):
        return True
    if word[:-1].isdigit() and word[-1] in ".)":
        return not rest.strip() or text.endswith(tuple("。！？；：!?;"))  # else a long clause that goes on
    return False


def plain_join(lines):
    """Each pair of neighbours is judged by itself; runs of pairs that go on are one line."""
    fences = [x.strip().startswith(("```", "~~~")) for x in lines]
    ideograph = lambda c: "\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff"

    def one(i):
        a, b = lines[i].strip(), lines[i + 1].strip()
        if sum(fences[: i + 2]) % 2 or not a or not b or standing_alone(lines[i]) or standing_alone(lines[i + 1]):
            return False
        return ideograph(a[-1]) and ideograph(b[0])

    pairs = [one(i) for i in range(len(lines) - 1)] + [False]
    out, run = [], []
    for i, goes in enumerate(pairs):
        run.append(i)
        if not goes:
            texts = [lines[k] for k in run]
            out.append(texts[0] if len(run) == 1 else texts[0].rstrip() + "".join(t.strip() for t in texts[1:-1]) + texts[-1].lstrip())
            run = []
    return out


def test_join_wrapped_is_the_fold(spark):
    rng = random.Random(3)
    pieces = ["天地", "人日。", " 月山", "水火 ", "| 土 |", "# 金", "- 木", "3. 石田", "4. 目。", "5.", "```", "", "<!--PAGE:02-->", "word", "~~~", "--- "]
    docs = [(i, "\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))) for i in range(400)]
    lines = spark.createDataFrame([(d, n, x) for d, t in docs for n, x in enumerate(t.split("\n"), 1)], "doc_id long, line_no long, line string")
    got = {}
    for r in cjk.join_wrapped(lines).orderBy("line_no").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    assert got == {d: plain_join(t.split("\n")) for d, t in docs}
    # the same within one row
    joined = spark.createDataFrame([(d, n, x) for d, ls in got.items() for n, x in enumerate(ls)], "doc_id long, line_no long, line string")
    want = {}
    for r in cjk.collapse_spaces(joined).orderBy("line_no").collect():
        want.setdefault(r.doc_id, []).append(r.out)
    whole = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id long, text string").select("doc_id", K.clean_text(F.col("text")).alias("text")).collect()
    assert {r.doc_id: r.text for r in whole} == {d: "\n".join(x) for d, x in want.items()} | {1000: None, 1001: ""}


def test_collapse_twice_changes_nothing(spark):
    rows = [(1, i, x) for i, x in enumerate(["天 地 人", "a 天 `日 月` 山 水", "天<br/>地 <BR> b", "```", "火 土", "```", "，金 木。 石"], 1)]
    once = cjk.collapse_spaces(spark.createDataFrame(rows, "doc_id long, line_no long, line string")).orderBy("line_no").collect()
    assert [r.out for r in once] == ["天地人", "a 天 `日 月` 山水", "天地 b", "```", "火 土", "```", "，金木。石"]
    twice = cjk.collapse_spaces(spark.createDataFrame([(1, i, r.out) for i, r in enumerate(once)], "doc_id long, line_no long, line string"))
    assert twice.agg(F.sum("removed")).first()[0] == 0


def test_split_rows_chain(spark):
    page = lambda *rows: "| a | b |\n|---|---|\n" + "\n".join(rows)
    pages = [(1, 1, page("| x |  |")), (1, 2, page("|  | y |", "| z |  |")), (1, 3, page("|  | w |", "text")), (2, 1, page("| x |  |")), (2, 3, page("|  | y |")), (3, 1, "no table"), (3, 2, page("|  | y |"))]
    out = {(r.doc_id, r.page_no): r.body for r in tables.split_rows(spark.createDataFrame(pages, "doc_id long, page_no long, body string")).collect()}
    assert out[1, 1] == page("|x|y|") and out[1, 2] == page("|z|w|") and out[1, 3] == page("text")
    assert out[2, 1] == pages[3][2] and out[3, 2] == pages[6][2]


def test_nms_is_the_fold(spark):
    rng = random.Random(5)
    boxes = [(0, p, i, x, y, x + rng.randrange(5, 60), y + rng.randrange(5, 60), rng.random()) for p in range(20) for i, (x, y) in enumerate((rng.randrange(80), rng.randrange(80)) for _ in range(12))]
    df = spark.createDataFrame(boxes, "doc_id long, page_no long, box_id long, x1 long, y1 long, x2 long, y2 long, score double")
    area = lambda b: (b[5] - b[3]) * (b[6] - b[4])
    want = set()
    for p in range(20):
        page = [b for b in boxes if b[1] == p]
        left = [b for b in page if not any(o is not b and area(b) < area(o) and b[3] >= o[3] and b[4] >= o[4] and b[5] <= o[5] and b[6] <= o[6] and area(b) / area(o) < 0.8 for o in page)]
        kept = []
        for b in sorted(left, key=lambda b: -b[7]):
            inter = lambda o: max(0, min(b[5], o[5]) - max(b[3], o[3])) * max(0, min(b[6], o[6]) - max(b[4], o[4]))
            if all(inter(o) / min(area(b), area(o)) <= 0.6 for o in kept):
                kept.append(b)
        want |= {(p, b[2]) for b in kept}
    assert {(r.page_no, r.box_id) for r in geometry.suppressed(df).collect()} == want


def test_grid_places_short_rows(spark):
    cells = [(0, 1, 1, 0, 0, 10, 10, "a"), (0, 1, 2, 20, 1, 30, 11, "b"), (0, 1, 3, 40, 0, 50, 10, "c"), (0, 1, 4, 0, 30, 10, 40, "d"), (0, 1, 5, 41, 31, 51, 41, "f"), (0, 1, 6, 19, 60, 29, 70, "g"), (0, 1, 7, 21, 61, 31, 71, "h")]
    df = spark.createDataFrame(cells, "doc_id long, page_no long, cell_id long, x1 long, y1 long, x2 long, y2 long, txt string")
    out = geometry.grid(df, spark.createDataFrame([(0, 1, 3)], "doc_id long, page_no long, nrows int")).orderBy("row", "col").collect()
    assert [r.txt for r in out] == ["a", "b", "c", "d", "", "f", "", "g", "h"]


def test_headings_fold(spark):
    lines = [(1, 1, 1, 100.0, 114.0, "Big title"), (1, 1, 2, 99.0, 109.0, "goes on"), (1, 1, 3, 80.0, 90.0, "body text"), (1, 1, 4, 60.0, 73.0, "ends here."), (1, 1, 5, 40.0, 53.0, "stop;"), (1, 1, 6, 20.0, 30.0, "body"), (1, 1, 7, 5.0, 15.0, "more")]
    df = spark.createDataFrame(lines, "doc_id long, page_no long, line_no long, yb double, yt double, txt string")
    body = headers.body_height(df)
    assert body.first().body_h == 10.0
    out = headers.headings(df, body).orderBy("line_no").collect()
    assert [(r.txt, r.level) for r in out] == [("## Big title goes on", 2), ("body text", None), ("### ends here.", 3), ("stop;", None), ("body", None), ("more", None)]


def test_crop_plan_remembers_only_what_it_accepted(spark):
    boxes = [(i, i, 5 + i, 5 + i) for i in range(6)]
    asked = [boxes[0], boxes[0], (1, 1, 1, 4), *boxes[1:6], boxes[5], boxes[1]]
    df = spark.createDataFrame([(1, 1, s, *b) for s, b in enumerate(asked)], "doc_id long, page_no long, seq long, x1 long, y1 long, x2 long, y2 long")
    out = [r.state for r in assembly.crop_plan(df).orderBy("seq").collect()]
    assert out == ["accepted", "repeated", "degenerate", "accepted", "accepted", "accepted", "over limit", "over limit", "over limit", "repeated"]


def test_flow_cleans_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "天地\n人日")], "doc_id long, text string")
    plan = Flow(docs).clean().promote().docs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_stream_into_files(spark, tmp_path):
    rows = [{"seq": s, "event": "page", "no": s % 4, "stats": {"status": "done"}, "duration": 1.0, "md": "天 地\n人"} for s in range(12)]
    (tmp_path / "in").mkdir()
    for i in range(0, 12, 4):
        (tmp_path / "in" / f"f{i}.json").write_text("\n".join(map(json.dumps, rows[i : i + 4])))
    shaped = events.cleaned(events.read_stream(spark, str(tmp_path / "in"), 1)).select(F.lit(1).alias("doc_id"), F.col("no").alias("page_no"), "seq", F.col("stats.status").alias("status"), "duration", "md")
    for _ in range(2):  # a second start adds nothing
        q = events.upsert_files(shaped, str(tmp_path / "out"), str(tmp_path / "ckpt"))
        q.processAllAvailable()
        q.stop()
    got = events.state(spark, str(tmp_path / "out"), shaped.schema).collect()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    assert sorted((r.page_no, r.seq) for r in got) == [(0, 8), (1, 9), (2, 10), (3, 11)]
    assert {r.md for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"天地人"}


def test_note_in_emptied_pages(spark):
    text = ["<!--PAGE:01-->", "", "| a | b |", "|---|---|", "| 1 | 2 |", "", "<!--/PAGE:01-->", "", "<!--PAGE:02-->", "", "| a | b |", "|---|---|", "| 3 | 4 |", "", "<!--/PAGE:02-->", "", "<!--PAGE:03-->", "<!--/PAGE:03-->"]
    before = spark.createDataFrame([(1, i, x) for i, x in enumerate(text, 1)], "doc_id long, line_no long, line string")
    out = [r.line for r in tables.noted(before, tables.continued(before), "<!-- note -->").orderBy("line_no").collect()]
    assert [x for x in out if x] == ["<!--PAGE:01-->", "| a | b |", "|---|---|", "| 1 | 2 |", "| 3 | 4 |", "<!--/PAGE:01-->", "<!--PAGE:02-->", "<!-- note -->", "<!--/PAGE:02-->", "<!--PAGE:03-->", "<!--/PAGE:03-->"]


def test_tall_glyphs_come_first(spark):
    glyph = lambda i, ch, l, b, t: (1, 1, i, ch, float(l), float(l) + 9, float(b), float(t))
    rows = [glyph(0, "T", 0, 0, 40), glyph(1, "a", 10, 10, 20), glyph(2, "b", 20, 10, 20), glyph(3, "c", 30, 10, 20), glyph(4, " ", 40, 10, 60)]
    g = spark.createDataFrame(rows, "doc_id long, page_no long, idx long, ch string, l double, r double, b double, t double")
    assert [r.text for r in geometry.glyph_rows(g).orderBy("row").collect()] == ["T", "abc"]
    two = spark.createDataFrame([glyph(0, "a", 0, 30, 40), glyph(1, "b", 10, 30, 40), glyph(2, "c", 0, 10, 20), glyph(3, "d", 10, 10, 20), glyph(4, "|", 200, 0, 10)], g.schema)
    side = lambda name, hi: spark.createDataFrame([(1, 1, 0, 0.0, float(hi))], f"doc_id long, page_no long, {name} int, lo double, hi double")
    assert {(r.band, r.col): r.text for r in geometry.glyph_cells(two, side("band", 50), side("col", 50)).collect()} == {(0, 0): "ab cd", (0, None): "\\|"}


def test_running_lines_on_one_page(spark):
    pages = [(1, 1, ["Title", "text", "1/13"]), (1, 2, ["other", "body 2", "版权所有 2020"]), (1, 3, ["7", "7", "third"]), (1, 4, ["x", "y", "第 4 页 共 9 页"])]
    lines = spark.createDataFrame([(d, p, i, x) for d, p, ls in pages for i, x in enumerate(ls, 1)], "doc_id long, page_no long, line_no long, txt string")
    assert sorted((r.page_no, r.key) for r in headers.by_page(lines).collect()) == [(1, "1/13"), (2, "版权所有2020"), (4, "第4页共9页")]


def test_flow(spark):
    docs = spark.createDataFrame([(1, "天地\n人日\n一、标题\n| a | b |\n|---|---|\n| 0 | 0.00 |\n| x | 1 |", "k"), (2, None, "n")], "doc_id long, text string, more string")
    out = {r.doc_id: r for r in Flow(docs).clean().promote().trim().assess().collect()}
    assert out[1].text == "天地人日一、标题\n| a | b |\n|---|---|\n| x | 1 |"
    assert out[1].score == 100 and out[1].more == "k" and out[2].more == "n"


def test_heading_levels(spark):
    lines = ["一、总则", "（二）范围", "第三，其他", "4、细则", "(5)附", "**一、粗**", "6. list", "# 一、", "| 一、 |", "一、" + "长" * 50, ""]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(K.heading_level(F.col("line")).alias("n"))
    assert [r.n for r in df.collect()] == [2, 3, 4, 5, 5, 2, None, None, None, None, None]
