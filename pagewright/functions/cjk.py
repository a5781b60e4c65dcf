"""Ideographic text: spaces and line breaks that layout put into words, and numbered headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_up, torn_digits, trim

#: Ideographs, and punctuation that goes with them.
IDEOGRAPH = r"\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
MARKS = r"\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\u2018\u2019\u201c\u201d\u2014\u2026"
SIDE = f"[{IDEOGRAPH}{MARKS}]"
GAP = f"(?<={SIDE}) (?={SIDE})"
BREAK = r"(?i)[ \t]*<br\s*/?>[ \t]*"
FENCE = r"\A\s*(?:```|~~~)"
STRUCTURE = r"\A\s*(\||#{1,6}\s|[-*+]\s|\d+[.)]\s|[-=*_]{3,}\s*\z|>|<!--|`|~~~|:\s*\z)"
CLAUSE = r"\A\s*\d+[.)]\s(?!.*[。！？；：!?;]\z)"
ANCHOR = r"\A<!--/?PAGE:\d+-->\z"
#: Numbering of headings and the level each stands for, tried in this order.
NUMERALS = "一二三四五六七八九十"
LEVELS = ((f"\\A[{NUMERALS}]{{1,3}}[、.．]", 2), (f"\\A[（(][{NUMERALS}]{{1,3}}[）)]", 3), (f"\\A第[{NUMERALS}]{{1,3}}[，,、]", 4), (r"\A\d{1,2}[、．]", 5), (r"\A[（(]\d{1,2}[）)]", 5))
HEADING_LENGTH = 40


def _outside_code(line: Column, change) -> Column:
    """change applied to what stands outside backticks."""
    parts = F.split(line, "`", -1)
    return F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 0, change(s)).otherwise(s)), "`")


def _count_outside_code(line: Column, pattern: str, prepare=lambda s: s) -> Column:
    parts = F.transform(F.split(line, "`", -1), lambda s, i: F.when(i % 2 == 0, F.regexp_count(prepare(s), F.lit(pattern))).otherwise(0))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def breaks_to_spaces(c: Column) -> Column:
    return F.regexp_replace(c, BREAK, " ")


def collapse(line: Column) -> Column:
    """One line: break tags become spaces, then single spaces between ideographic characters go; inline code stays."""
    return _outside_code(line, lambda s: F.regexp_replace(breaks_to_spaces(s), GAP, ""))


def collapsed(line: Column) -> tuple[Column, Column]:
    """(break tags, spaces removed) of collapse()."""
    return _count_outside_code(line, BREAK), _count_outside_code(line, GAP, breaks_to_spaces)


def stats(c: Column) -> dict[str, Column]:
    """The observed rate of injected spaces; code is not left out here."""
    wide = F.octet_length(c) > F.length(c)  # plain ASCII has none
    chars, gaps = (F.when(wide, F.regexp_count(c, F.lit(p))).otherwise(0) for p in (SIDE, GAP))
    per = F.when(chars > 0, half_up(gaps * 100000.0 / chars) / 100.0).otherwise(0.0)
    return {"cjk_chars": chars.cast("long"), "injected": gaps.cast("long"), "per_1k": per, "torn_digits": torn_digits(c).cast("long")}


def structural(line: Column) -> Column:
    """Table, heading, list, rule, quote, comment or code; a long numbered clause that goes on is none."""
    return line.rlike(STRUCTURE) & ~(line.rlike(CLAUSE) & ~line.rlike(r"\A\s*\d+[.)]\s*\z"))


def anchor(line: Column) -> Column:
    return trim(line).rlike(ANCHOR)


def goes_on(before: Column, line: Column) -> Column:
    """Whether a line continues the one before: both plain, ideographs on both sides of the break."""
    plain = ~structural(before) & ~structural(line) & ~anchor(before) & ~anchor(line)
    return plain & trim(before).rlike(f"[{IDEOGRAPH}]\\z") & trim(line).rlike(f"\\A[{IDEOGRAPH}]")


def _bound(value: Column, use) -> Column:
    """use(value) with value worked out once, also where use() has lambdas that refer to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _whole(text: Column) -> Column:
    """One stretch of text without fences: wrapped lines joined, then each line collapsed."""

    def joined(lines):
        on = F.transform(lines, lambda x, i: F.when(i == 0, False).otherwise(F.coalesce(goes_on(F.get(lines, i - 1), x), F.lit(False))))
        return _bound(on, lambda on: F.array_join(F.transform(lines, lambda x, i: part(on, x, i)), ""))

    def part(on, x, i):
        here, then = F.get(on, i), F.coalesce(F.get(on, i + 1), F.lit(False))
        cut = F.when(here & then, trim(x)).when(here, F.regexp_replace(x, r"(?U)\A\s+", "")).when(then, F.regexp_replace(x, r"(?U)\s+\z", "")).otherwise(x)
        return F.concat(F.when(here | (i == 0), F.lit("")).otherwise(F.lit("\n")), cut)

    return F.array_join(F.transform(F.split(_bound(F.split(text, "\n", -1), joined), "\n", -1), collapse), "\n")


def clean_text(text: Column) -> Column:
    """A whole text as join_wrapped() and collapse_spaces() leave it, within its own row: nothing is shuffled. Fenced stretches stay."""
    fence = r"(?m)^[^\S\n]*(?:```|~~~)[^\n]*$"
    parts = F.arrays_zip(F.split(text, fence, -1).alias("part"), F.regexp_extract_all(text, F.lit(fence), F.lit(0)).alias("fence"))
    return F.array_join(F.transform(parts, lambda x, i: F.concat(F.when(i % 2 == 0, _whole(x["part"])).otherwise(x["part"]), F.coalesce(x["fence"], F.lit("")))), "")


def promoted_text(text: Column) -> Column:
    """A whole text with its numbered headings promoted."""
    return F.array_join(F.transform(F.split(text, "\n", -1), promoted), "\n")


def promotions(text: Column) -> Column:
    """How many lines of a text are promoted."""
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: heading_level(x).isNotNull()))


def without_emphasis(line: Column) -> Column:
    """Nested emphasis marks at both ends go."""
    return F.regexp_replace(trim(line), r"(?U)\A(?:\*+\s*)+|(?:\s*\*+)+\z", "")


def heading_level(line: Column) -> Column:
    t, s = trim(line), without_emphasis(line)
    marked = t.rlike(r"\A(#{1,6}\s|\||<!--|>|```|~~~|[-*+]\s|\d+\.\s)")
    out = F.when(marked | (s == "") | (F.length(s) > HEADING_LENGTH), None)
    for pattern, level in LEVELS:
        out = out.when(s.rlike(pattern), level)
    return out.otherwise(None).cast("int")


def promoted(line: Column) -> Column:
    level = heading_level(line)
    return F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), without_emphasis(line))).otherwise(line)
