"""Queries of the table rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import lines as L
from ..operators import tables as O
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)

_CELLS = "list_transform(string_split(substr(trim(line), 2, length(trim(line)) - 2), '|'), lambda c: trim(c))"
_ROW = "(trim(line) LIKE '|%|')"


@query(
    f"""SELECT doc_id, count(*) FILTER ({_ROW} AND NOT (contains(line, '-') AND regexp_matches(trim(line), '^\\|[\\s:|-]+\\|$')) AND len(list_filter({_CELLS}, lambda c: c <> '' AND NOT regexp_matches(c, '^[-+]?0+(\\.0+)?%?$'))) = 0)::BIGINT AS removed, count(*)::BIGINT AS lines FROM noise_table_rows GROUP BY doc_id""",
    "noise_table_rows",
)
def noise_rows(lines):
    return O.doc_noise(lines)


_BENT = "CASE WHEN line_no % 5 = 0 THEN concat(line, ' x |') WHEN line_no % 11 = 0 THEN 'text between' ELSE line END"


@query(
    f"""WITH b AS (SELECT doc_id, line_no, {_BENT} AS line FROM table_rows), m AS (SELECT *, line LIKE '|%' AS bar FROM b),
r AS (SELECT *, sum(CASE WHEN bar THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM m),
n AS (SELECT *, row_number() OVER w AS n, length(line) - length(replace(line, '|', '')) - 1 AS wd, first_value(length(line) - length(replace(line, '|', '')) - 1) OVER w AS hw FROM r WHERE bar AND NOT regexp_matches(line, '^\\|[\\s:-]+\\|[\\s:|-]*$') WINDOW w AS (PARTITION BY doc_id, run ORDER BY line_no))
SELECT doc_id, count(*) FILTER (n = 1)::BIGINT AS tables, count(*) FILTER (n > 1)::BIGINT AS rows, count(*) FILTER (n > 1 AND wd <> hw)::BIGINT AS bad_rows FROM n GROUP BY doc_id""",
    "table_rows",
)
def table_shape(lines):
    return O.shape(lines.selectExpr("doc_id", "line_no", f"{_BENT} as line"))


_QUALITY = f"""
u AS (SELECT doc_id, line_no, line FROM table_rows UNION ALL SELECT -1 - doc_id, line_no, line FROM doc_lines),
m AS (SELECT doc_id, line_no, trim(line) AS t, {_ROW} AND NOT regexp_matches(trim(line), '^\\|[\\s:-]+\\|$') AND length(trim(line)) > 1 AS r, {_CELLS} AS cells, len(regexp_extract_all(line, '[0-9] [0-9](?: [0-9])*')) AS torn FROM u),
c AS (SELECT *, t <> '' AND t NOT LIKE '|%' AND t NOT LIKE '#%' AND t NOT LIKE '<!--%' AND NOT regexp_matches(t, '^(-{{3,}}|\\*{{3,}})$') AS c, CASE WHEN r THEN len(cells) END AS w, CASE WHEN r THEN len(list_filter(cells, lambda x: x = '')) ELSE 0 END AS empty FROM m),
j AS (SELECT *, r AND coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <> w, false) AS jit FROM c),
s AS (SELECT doc_id, count(*) FILTER (r)::BIGINT AS tr, coalesce(sum(w), 0) AS cells, sum(empty) AS e, count(*) FILTER (r AND empty > 0) AS we, count(*) FILTER (jit) AS j, count(*) FILTER (c)::BIGINT AS cl, count(*) FILTER (c AND length(t) <= 4) AS sh, sum(torn)::BIGINT AS torn FROM j GROUP BY doc_id),
q AS (SELECT doc_id, tr, cl, torn, CASE WHEN tr >= 4 THEN we::DOUBLE / tr ELSE 0 END AS fr, CASE WHEN cells > 0 THEN e::DOUBLE / cells ELSE 0 END AS er, CASE WHEN tr >= 4 THEN j::DOUBLE / tr ELSE 0 END AS jr, CASE WHEN cl >= 6 THEN sh::DOUBLE / cl ELSE 0 END AS sr FROM s),
z AS (SELECT *, tr >= 4 AND fr >= 0.5 AS fragd, cl >= 20 AND sr >= 0.9 AS cf FROM q)
"""


@query(
    f"""WITH {_QUALITY}
SELECT doc_id, tr AS table_rows, cl AS content_lines, floor(fr * 100 + 0.5) / 100.0::DOUBLE AS frag, floor(er * 100 + 0.5) / 100.0::DOUBLE AS empty_cells, floor(jr * 100 + 0.5) / 100.0::DOUBLE AS jitter, floor(sr * 100 + 0.5) / 100.0::DOUBLE AS short, 0::BIGINT AS injected, 0.0::DOUBLE AS per_1k, torn AS torn_digits, cf AS char_fragmented,
  greatest(0, CASE WHEN cf THEN least(20, 100 - CASE WHEN fragd THEN least(50, floor((fr - 0.3) * 80 + 0.5)) ELSE 0 END) ELSE 100 - CASE WHEN fragd THEN least(50, floor((fr - 0.3) * 80 + 0.5)) ELSE 0 END END - CASE WHEN jr > 0.3 AND tr >= 4 THEN least(15, floor((jr - 0.3) * 40 + 0.5)) ELSE 0 END)::BIGINT AS score,
  fragd OR cf AS suggest_vision, CASE WHEN cf THEN 'vision: whole document' WHEN fragd THEN 'vision: pages concerned' ELSE 'text' END AS route
FROM z""",
    "table_rows",
    "doc_lines",
)
def doc_quality(rows, lines):
    both = rows.select("doc_id", "line_no", "line").unionByName(lines.select((-1 - F.col("doc_id")).alias("doc_id"), "line_no", "line"))
    return O.scored(O.signals(both))


_PAGED = """SELECT doc_id, line_no * 10 AS line_no, CASE WHEN line_no = 2 THEN '| --- | --- | --- |' ELSE line END AS line FROM table_rows
UNION ALL SELECT doc_id, line_no * 10 + 1, '<!--/PAGE:01-->' FROM table_rows WHERE line_no % 4 = 3
UNION ALL SELECT doc_id, line_no * 10 + 2, '' FROM table_rows WHERE line_no % 4 = 3
UNION ALL SELECT doc_id, line_no * 10 + 3, CASE WHEN doc_id % 5 = 0 THEN 'words' ELSE '<!--PAGE:02-->' END FROM table_rows WHERE line_no % 4 = 3
UNION ALL SELECT doc_id, line_no * 10 + 4, CASE WHEN doc_id % 2 = 0 THEN '| n | flag | qty |' ELSE '| 0 | demoted | 0 |' END FROM table_rows WHERE line_no % 4 = 3
UNION ALL SELECT doc_id, line_no * 10 + 5, '|---|---|---|' FROM table_rows WHERE line_no % 4 = 3"""


@query(
    f"""WITH p AS ({_PAGED}),
m AS (SELECT *, regexp_matches(line, '^\\s*\\|.*\\|\\s*$') AS bar, trim(line) = '' OR regexp_matches(trim(line), '^<!--/?PAGE:[0-9]+-->$') AS blank FROM p),
b AS (SELECT *, sum(CASE WHEN bar THEN 0 ELSE 1 END) OVER w AS block, sum(CASE WHEN NOT bar AND NOT blank THEN 1 ELSE 0 END) OVER w AS wall FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY line_no) AS n FROM b WHERE bar),
e AS (SELECT doc_id, block, min(line_no) AS start, max(line_no) AS ende, max(wall) AS wall, max(CASE WHEN n = 1 THEN line END) AS head, count(*) >= 3 AND bool_or(n = 2 AND contains(line, '-') AND regexp_matches(trim(line), '^\\|[\\s:|-]+\\|$')) AND max(CASE WHEN n = 1 THEN length(line) - length(replace(line, '|', '')) - 1 END) >= 2 AS ok, max(CASE WHEN n = 1 THEN length(line) - length(replace(line, '|', '')) - 1 END) AS wd FROM n GROUP BY doc_id, block),
o AS (SELECT *, coalesce(ok AND lag(ok) OVER w AND lag(wall) OVER w = wall AND lag(wd) OVER w = wd, false) AS goes FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
c AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS chain FROM o),
f AS (SELECT *, first_value(ende) OVER w AS dest, first_value(head) OVER w = head AS same FROM c WINDOW w AS (PARTITION BY doc_id, chain ORDER BY start)),
all_ AS (SELECT b.doc_id, b.line_no, b.line, n.n, coalesce(f.goes, false) AS goes, f.dest, f.same FROM b LEFT JOIN n USING (doc_id, line_no) LEFT JOIN f ON f.doc_id = b.doc_id AND f.block = n.block)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN goes THEN dest ELSE line_no END, CASE WHEN goes THEN line_no ELSE 0 END)::BIGINT AS line_no, line FROM all_ WHERE NOT (goes AND (n = 2 OR (n = 1 AND same)))""",
    "table_rows",
)
def continued_tables(rows):
    spark = rows.sparkSession
    return O.continued(spark.sql(_PAGED.replace("table_rows", "{t}"), t=rows))


_SPLIT = """SELECT doc_id, page_no, concat('| a | b |', chr(10), '|---|---|', chr(10), CASE WHEN page_no > 1 AND page_no % 3 = 2 THEN concat('|  | tail', page_no, ' |', chr(10)) ELSE '' END, '| x | y |', CASE WHEN page_no % 3 = 1 THEN concat(chr(10), '| head', page_no, ' |  |') ELSE '' END) AS body FROM doc_pages"""


@query(
    f"""WITH s AS ({_SPLIT}), m AS (SELECT *, page_no % 3 = 1 AND lead(page_no) OVER w = page_no + 1 AS here, page_no % 3 = 2 AND lag(page_no) OVER w = page_no - 1 AS there FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY page_no))
SELECT doc_id, page_no, CASE WHEN coalesce(here, false) THEN replace(body, concat('| head', page_no, ' |  |'), concat('|head', page_no, '|tail', page_no + 1, '|')) WHEN coalesce(there, false) THEN replace(body, concat('|  | tail', page_no, ' |', chr(10)), '') ELSE body END AS body, coalesce(here, false)::INT AS merged FROM m""",
    "doc_pages",
)
def split_row_merge(pages):
    return O.split_rows(pages.sparkSession.sql(_SPLIT.replace("doc_pages", "{p}"), p=pages))


@query(
    """SELECT doc_id, CASE WHEN n < 2 THEN '' ELSE concat('| ', array_to_string(list_transform(c1, lambda x: replace(x, '|', chr(92) || '|')), ' | '), ' |', chr(10), '| --- | --- | --- |', chr(10), rest) END AS md, n < 2 AS fake
FROM (SELECT doc_id, count(*) AS n, first(cells ORDER BY line_no) AS c1, string_agg(concat('| ', array_to_string(list_transform(cells, lambda x: replace(x, '|', chr(92) || '|')), ' | '), CASE WHEN len(cells) = 2 THEN ' | ' ELSE '' END, ' |'), chr(10) ORDER BY line_no) FILTER (line_no > 1) AS rest
  FROM (SELECT doc_id, line_no - 2 AS line_no, CASE WHEN line_no % 4 = 0 THEN ['a|b', line_no::VARCHAR] ELSE ['x y', 'z', line_no::VARCHAR] END AS cells FROM table_rows WHERE line_no > 2) GROUP BY doc_id)""",
    "table_rows",
)
def table_render(rows):
    wide = F.array(F.lit(" x\n y"), F.lit("z"), F.col("line_no").cast("string"))
    grid = rows.filter("line_no > 2").select("doc_id", "line_no", F.when(F.col("line_no") % 4 == 0, F.array(F.lit("a|b"), F.col("line_no").cast("string"))).otherwise(wide).alias("cells"))
    g = grid.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "cells"))), lambda x: x["cells"]).alias("g"))
    return g.select("doc_id", T.rendered(F.col("g")).alias("md"), T.fake(F.col("g")).alias("fake"))


@query(
    "SELECT doc_id, page_no, CASE WHEN tables = 0 AND formulas = 0 THEN 'none' WHEN tables = 0 OR (formulas > 0 AND text_regions * 90 > 200) THEN 'legacy' ELSE 'primary' END AS source FROM probe",
    "probe",
)
def table_source_choice(probe):
    p = probe.select("doc_id", "page_no", F.col("tables").alias("primary"), F.col("formulas").alias("legacy"), (F.col("text_regions") * 90).alias("longest"))
    return O.page_source(p).select("doc_id", "page_no", "source")


@query(
    "SELECT doc_id, line_no, " + ", ".join(f"regexp_matches(x, '{p}') AS {n}" for n, p in (("quality", r"^\|[\s:-]+\|$"), ("cross", r"^\|\s*:?-{2,}"), ("metric", r"^\|\s*---"))) + r", contains(x, '-') AND regexp_matches(x, '^\|[\s:|-]+\|$') AS scan FROM (SELECT doc_id, line_no, CASE line_no % 4 WHEN 2 THEN line WHEN 3 THEN '| :-: |' WHEN 0 THEN '|--|' ELSE '|  |  |' END AS x FROM table_rows)",
    "table_rows",
)
def separators(rows):
    x = F.expr("CASE line_no % 4 WHEN 2 THEN line WHEN 3 THEN '| :-: |' WHEN 0 THEN '|--|' ELSE '|  |  |' END")
    return rows.select("doc_id", "line_no", T.sep_quality(x).alias("quality"), T.sep_cross(x).alias("cross"), T.sep_metric(x).alias("metric"), T.sep_scan(x).alias("scan"))


@query("SELECT doc_id, count(*)::BIGINT AS rows, max(len(c))::BIGINT AS cols, max(list_max(list_transform(c, lambda x: length(trim(x)))))::BIGINT AS longest FROM (SELECT doc_id, string_split(line[2:-2], '|') AS c FROM table_rows WHERE NOT contains(line, '---')) GROUP BY doc_id", "table_rows")
def cell_stats(lines):
    return O.cell_stats(lines)
