"""Queries of the ideographic rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cjk
from ..operators import cjk as C
from ..fixtures import IDEOGRAPHS, LETTERS
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)

_I = "㐀-䶿一-鿿豈-\ufaff"
_S = f"[{_I}\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65‘’“”—…]"
_TWO = "regexp_replace(regexp_replace({x}, '({s}) ({s})', '\\1\x01\\2', 'g'), '({s}) ({s})', '\\1\x01\\2', 'g')".replace("{s}", _S)


def _gaps(x):
    """RE2 knows no look-around: mark gaps in two passes, as neighbours share characters."""
    return _TWO.replace("{x}", x)


@query(
    f"""SELECT doc_id, line_no, c AS cjk_chars, g AS injected, CASE WHEN c > 0 THEN floor(g * 100000.0::DOUBLE / c + 0.5) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS per_1k, len(regexp_extract_all(line, '[0-9] [0-9](?: [0-9])*'))::BIGINT AS torn_digits
FROM (SELECT doc_id, line_no, line, len(regexp_extract_all(line, '{_S}'))::BIGINT AS c, (length({_gaps("line")}) - length(replace({_gaps("line")}, '\x01', '')))::BIGINT AS g FROM cjk_lines)""",
    "cjk_lines",
)
def cjk_stats(lines):
    return lines.select("doc_id", "line_no", *[c.alias(k) for k, c in cjk.stats(F.col("line")).items()])


@query(f"SELECT doc_id, line_no, replace({_gaps('line')}, '\x01', '') AS out, (length(line) - length(replace({_gaps('line')}, '\x01', '')))::BIGINT AS removed FROM cjk_lines", "cjk_lines")
def cjk_collapse(lines):
    return C.collapse_spaces(lines).select("doc_id", "line_no", "out", F.col("removed").cast("long"))


_TAGGED = "CASE WHEN line_no % 3 = 0 THEN concat(line, ' <BR /> ', line) WHEN line_no % 7 = 0 THEN '```' WHEN line_no % 5 = 0 THEN concat('`天 地` ', line, '<br>日') ELSE line END"


_SPACED = _TWO.replace("{x}", "regexp_replace(s, '(?i)[ \\t]*<br\\s*/?>[ \\t]*', ' ', 'g')")


@query(
    f"""WITH t AS (SELECT doc_id, line_no, {_TAGGED} AS line FROM cjk_lines), f AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence FROM t),
p AS (SELECT *, fence OR sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS protected, string_split(line, '`') AS parts FROM f),
c AS (SELECT *, list_transform(parts, lambda s, i: CASE WHEN i % 2 = 1 THEN {_SPACED} ELSE s END) AS marked, list_sum(list_transform(parts, lambda s, i: CASE WHEN i % 2 = 1 THEN len(regexp_extract_all(s, '(?i)<br\\s*/?>')) ELSE 0 END)) AS tags FROM p)
SELECT doc_id, line_no, CASE WHEN protected THEN line ELSE replace(array_to_string(marked, '`'), '\x01', '') END AS out, CASE WHEN protected THEN 0 ELSE tags END::BIGINT AS br_tags, CASE WHEN protected THEN 0 ELSE length(array_to_string(marked, '`')) - length(replace(array_to_string(marked, '`'), '\x01', '')) END::BIGINT AS removed, protected FROM c""",
    "cjk_lines",
)
def br_downgrade(lines):
    """Break tags, inline code and fences."""
    tagged = lines.selectExpr("doc_id", "line_no", f"{_TAGGED} as line")
    return C.collapse_spaces(tagged).select("doc_id", "line_no", "out", F.col("br_tags").cast("long"), F.col("removed").cast("long"), "protected")


@query(
    f"""WITH t AS (SELECT *, trim(line) AS x, trim(lead(line) OVER w) AS nx FROM cjk_lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
f AS (SELECT doc_id, x <> '' AS body, coalesce(nx <> '' AND regexp_matches(x, '[{_I}]$') AND regexp_matches(nx, '^[{_I}]'), false) AS wrap FROM t)
SELECT doc_id, count(*) FILTER (wrap)::BIGINT AS wraps, count(*) FILTER (body)::BIGINT AS body_lines, CASE WHEN count(*) FILTER (body) > 0 THEN floor(count(*) FILTER (wrap) * 10000.0::DOUBLE / count(*) FILTER (body) + 0.5) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS per_100 FROM f GROUP BY doc_id""",
    "cjk_lines",
)
def wrap_metric(lines):
    return C.wrap_metric(lines)


@query(
    f"""WITH f AS (SELECT *, coalesce(regexp_matches(lag(line) OVER w, '[{_I}]\\s*$') AND regexp_matches(line, '^\\s*[{_I}]'), false) AS goes FROM cjk_lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run, coalesce(lead(goes) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS nxt FROM f)
SELECT doc_id, min(line_no)::BIGINT AS line_no, string_agg(CASE WHEN goes AND nxt THEN trim(line) WHEN goes THEN ltrim(line) WHEN nxt THEN rtrim(line) ELSE line END, '' ORDER BY line_no) AS line, (count(*) - 1)::BIGINT AS joined FROM r GROUP BY doc_id, run""",
    "cjk_lines",
)
def join_wrapped(lines):
    return C.join_wrapped(lines)


_HEADED = "CASE line_no % 8 WHEN 0 THEN concat('**', '一、', substr(line, 1, 12), '**') WHEN 1 THEN concat('（二）', substr(line, 1, 30)) WHEN 2 THEN concat('第三，', substr(line, 1, 60)) WHEN 3 THEN concat('4、', substr(line, 1, 9)) WHEN 4 THEN concat('(5)', substr(line, 1, 9)) WHEN 5 THEN concat('6. ', line) WHEN 6 THEN concat('| 一、', line) ELSE line END"


@query(
    f"""WITH h AS (SELECT doc_id, line_no, {_HEADED} AS line FROM cjk_lines),
s AS (SELECT *, trim(line) AS t, trim(regexp_replace(regexp_replace(trim(line), '^(\\*+\\s*)+', ''), '(\\s*\\*+)+$', '')) AS s FROM h),
l AS (SELECT *, CASE WHEN regexp_matches(t, '^(\\||[0-9]+\\.\\s)') OR length(s) > 40 THEN NULL WHEN regexp_matches(s, '^[一二三四五六七八九十]{{1,3}}[、.．]') THEN 2 WHEN regexp_matches(s, '^[（(][一二三四五六七八九十]{{1,3}}[）)]') THEN 3
  WHEN regexp_matches(s, '^第[一二三四五六七八九十]{{1,3}}[，,、]') THEN 4 WHEN regexp_matches(s, '^[0-9]{{1,2}}[、．]') THEN 5 WHEN regexp_matches(s, '^[（(][0-9]{{1,2}}[）)]') THEN 5 END AS level FROM s)
SELECT doc_id, line_no, level, CASE WHEN level IS NOT NULL THEN concat(repeat('#', level), ' ', s) ELSE line END AS out FROM l""",
    "cjk_lines",
)
def cn_heading_level(lines):
    h = lines.selectExpr("doc_id", "line_no", f"{_HEADED} as line")
    return h.select("doc_id", "line_no", cjk.heading_level(F.col("line")).alias("level"), cjk.promoted(F.col("line")).alias("out"))


_DOCS = f"SELECT doc_id, translate(lower(text), '{LETTERS}', '{IDEOGRAPHS}') AS text FROM documents"
_ONE = _gaps("line")


@query(
    f"""WITH d AS (SELECT doc_id, replace(text, concat('.', chr(10)), chr(10)) AS text FROM ({_DOCS})), l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
f AS (SELECT *, coalesce(regexp_matches(lag(line) OVER w, '[{_I}]\\s*$') AND regexp_matches(line, '^\\s*[{_I}]'), false) AS goes FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run, coalesce(lead(goes) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS nxt FROM f),
j AS (SELECT doc_id, run, string_agg(CASE WHEN goes AND nxt THEN trim(line) WHEN goes THEN ltrim(line) WHEN nxt THEN rtrim(line) ELSE line END, '' ORDER BY line_no) AS line FROM r GROUP BY doc_id, run)
SELECT doc_id, string_agg(replace({_ONE}, '\x01', ''), chr(10) ORDER BY run) AS text FROM j GROUP BY doc_id""",
    "documents",
)
def clean_text(documents):
    """Whole documents, each within its own row."""
    text = F.translate(F.lower("text"), LETTERS, IDEOGRAPHS)
    return documents.select("doc_id", cjk.clean_text(F.replace(text, F.lit(".\n"), F.lit("\n"))).alias("text"))
