"""URL filters by a temporal join with dated lists (operator 2).

List entries are dated: one adds a value (a host, a domain or a host with a
path prefix), a later one removes it. Entries of a value become disjoint
validity intervals. Each capture looks up every domain suffix and path prefix
of its URL, and the interval that holds its fetch time decides (as of that
time, not of today).

Both sides meet on the key. A value has few intervals, however many captures
its host has, so Spark's skew handling can split a hot host's captures; an
interval meets a capture only within its own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-cased, without user, port, trailing dot and a leading www."""
    raw = F.lower(F.regexp_extract(url, r"\A\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(raw, r"\Awww\.|\.\z", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"\A\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)", 1)


def keys(url: Column) -> Column:
    """Every suffix of the host with two labels at least (or the host itself), and the host with every prefix of whole path segments, ended by "/"."""
    h = host(url)
    labels, parts = F.split(h, r"\."), F.filter(F.split(path(url), "/"), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(h, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.concat(suffixes, F.when(F.size(parts) > 0, prefixes).otherwise(F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list, value, action, day) -> list, value, since, until (null: open): disjoint times in which a value is listed.

    Of several entries of one day a removal counts. Adding what is listed, and
    removing what is not, changes nothing. Entries with a null are ignored;
    values are compared in lower case.
    """
    e = entries.select("list", F.lower(F.trim("value")).alias("value"), (F.lower("action") == "add").alias("on"), F.col("day").cast("date").alias("day")).na.drop()
    day = e.groupBy("list", "value", "day").agg(F.bool_and("on").alias("on"))
    w = Window.partitionBy("list", "value").orderBy("day")
    turns = day.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).filter("on <> was")
    return turns.withColumn("until", F.lead("day").over(w)).filter("on").select("list", "value", F.col("day").alias("since"), "until")


def hits(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, day, list, value: for each row of captures (page_id, url, day) what was listed on its day; day null: nothing."""
    looked = captures.select("page_id", F.col("day").cast("date").alias("day"), F.explode(F.array_distinct(keys(F.col("url").cast("string")))).alias("value"))
    found = looked.join(intervals(entries).hint("merge"), "value").filter((F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    return found.select("page_id", "day", "list", "value")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, day, n_hits, lists, keep: one row for each different (page_id, url, day) of captures.

    Null page_ids, URLs and days stay, with no hits where there is no URL or no
    day. Repeated rows are one; other columns are ignored. Empty tables: empty
    result, or all kept.
    """
    rows = captures.select("page_id", F.col("url").cast("string").alias("url"), F.col("day").cast("date").alias("day")).distinct().withColumn("rid", F.xxhash64("page_id", "url", "day"))
    found = hits(rows.select(F.struct("rid", F.coalesce("page_id", F.lit(-(2**63)))).alias("page_id"), "url", "day"), entries)
    each = found.groupBy("page_id").agg(F.count("*").alias("n_hits"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists")).withColumnRenamed("page_id", "row")
    out = rows.join(each, F.struct("rid", F.coalesce("page_id", F.lit(-(2**63)))) == F.col("row"), "left")
    return out.select("page_id", "day", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n_hits").isNull().alias("keep"))
