"""Scalar text rules as columns. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of wrongly decoded text.
MOJIBAKE = {"replacement": "�+", "classic": "锟斤拷|烫烫烫|屯屯屯", "high_bytes": "[À-ÿ][\u0080-¿]{2,}", "accents": "[À-ÿ]{4,}"}
MOJIBAKE_CAP = 50
SPACE = r"(?U)\s+"


def trim(c: Column) -> Column:
    """Without white space of any script at the ends."""
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))  # most lines need no pass
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")).otherwise(c)


def without_space(c: Column) -> Column:
    """For comparison: no white space at all."""
    return F.regexp_replace(c, SPACE, "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, " ")


def half_up(c: Column) -> Column:
    """Rounding to a whole number, halves upwards."""
    return F.floor(c + 0.5)


def visible(c: Column) -> Column:
    """A page block's content that a reader sees: no anchors, no comments, no white space."""
    return without_space(F.regexp_replace(c, r"(?s)<!--.*?-->", ""))


def visible_length(c: Column) -> Column:
    return F.length(visible(c))


def mojibake(c: Column) -> dict[str, Column]:
    """Hits of each sign, as many as serve for evidence."""
    return {k: F.least(F.regexp_count(c, F.lit(p)), F.lit(MOJIBAKE_CAP)) for k, p in MOJIBAKE.items()}


def mojibake_sample(c: Column, width: int = 12) -> Column:
    """The first suspicious place with what stands around it."""
    at = F.regexp_instr(c, F.lit("|".join(MOJIBAKE.values())))
    hit = F.regexp_substr(c, F.lit("|".join(MOJIBAKE.values())))
    start = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, squeeze(F.substring(c, start, at - start + F.length(hit) + width)))


def torn_digits(c: Column) -> Column:
    """Runs of digits that single spaces tear apart; counted, never mended."""
    return F.regexp_count(c, F.lit(r"[0-9] [0-9](?: [0-9])*"))


def url_tail(c: Column) -> Column:
    """The file name at the end of a URL, or nothing."""
    path = F.regexp_replace(F.regexp_extract(c, r"\A([^?#]*)", 1), r"/+\z", "")
    tail = F.substring_index(path, "/", -1)
    return F.when(F.contains(tail, F.lit(".")), tail).otherwise("")


def is_link(c: Column) -> Column:
    return c.rlike(r"\A(?i:https?://|mailto:)")


def inline_links(body: Column, links: Column) -> Column:
    """Fold over ordered links (struct anchor, url): the first place of the anchor, or of the URL's file name, becomes a link; the rest, and no URL twice, ends in a list at the page's end."""

    def fold(acc, x):
        fits = lambda w: (F.length(w) > 3) & (F.length(w) <= 120) & (F.instr(acc["body"], w) > 0)
        tail = url_tail(x["url"])
        word = F.when(fits(x["anchor"]), x["anchor"]).when(fits(tail), tail)
        at = F.instr(acc["body"], word)
        linked = F.concat(F.substr(acc["body"], F.lit(1), at - 1), F.lit("["), word, F.lit("]("), x["url"], F.lit(")"), F.substr(acc["body"], at + F.length(word)))
        seen = F.array_contains(acc["seen"], x["url"])
        return F.struct(
            F.when(seen | word.isNull(), acc["body"]).otherwise(linked).alias("body"),
            F.when(seen, acc["seen"]).otherwise(F.array_append(acc["seen"], x["url"])).alias("seen"),
            F.when(~seen & word.isNull(), F.array_append(acc["notes"], x["url"])).otherwise(acc["notes"]).alias("notes"),
            (acc["inlined"] + F.when(~seen & word.isNotNull(), 1).otherwise(0)).alias("inlined"),
        )

    none = F.array().cast("array<string>")
    start = F.struct(body.alias("body"), none.alias("seen"), none.alias("notes"), F.lit(0).alias("inlined"))

    def finish(acc):
        listed = F.concat(F.regexp_replace(acc["body"], r"(?U)\s+\z", ""), F.lit("\n\nLinks on this page:\n"), F.array_join(F.transform(acc["notes"], lambda u: F.concat(F.lit("- "), u)), "\n"))
        return F.struct(F.when(F.size(acc["notes"]) > 0, listed).otherwise(acc["body"]).alias("body"), acc["inlined"].alias("inlined"), F.size(acc["notes"]).alias("notes"))

    return F.aggregate(links, start, fold, finish)


def render(template: Column, values: dict[str, Column]) -> Column:
    """{{KEY}} replaced; keys without a value become nothing."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), v)
    return F.regexp_replace(template, r"\{\{[A-Za-z0-9_]+\}\}", "")


def missing_keys(template: Column, keys: list[str]) -> Column:
    """Keys of a template that have no value; a strict rendering fails if there are any."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{([A-Za-z0-9_]+)\}\}"), F.lit(1))), F.array(*map(F.lit, keys)))


def edit_ratio(a: Column, b: Column, limit: int = 20000) -> Column:
    """Normalised edit distance; beyond the limit, one minus the Jaccard index of the line sets."""
    longest = F.greatest(F.length(a), F.length(b))
    near = F.try_divide(F.levenshtein(a, b).cast("double"), longest)
    return F.when(longest == 0, 0.0).when(longest <= limit, near).otherwise(1 - line_jaccard(a, b))


def line_jaccard(a: Column, b: Column) -> Column:
    x, y = F.split(a, "\n", -1), F.split(b, "\n", -1)
    return F.size(F.array_intersect(x, y)).cast("double") / F.size(F.array_union(x, y))
