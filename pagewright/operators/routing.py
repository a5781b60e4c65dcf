"""Which way a document goes: probes, complexity, routes, candidates, page gates, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIO, NEAR, GATE, SECONDS = 0.4, 0.7, 30, 27


def probe_pages(total: Column) -> Column:
    """Sample pages: all of up to three, else the first and those at a third and two thirds."""
    third = F.greatest(F.lit(2), F.floor(total / 3))
    two = F.least(total, F.greatest(third + 1, F.floor(2 * total / 3)))
    few = F.sequence(F.lit(1).cast("long"), F.greatest(total.cast("long"), F.lit(1)))
    return F.when(total <= 3, few).otherwise(F.array_sort(F.array_distinct(F.array(F.lit(1).cast("long"), third.cast("long"), two.cast("long")))))


def complexity(probe: DataFrame) -> DataFrame:
    """doc_id, valid, tables, formulas, text_regions, ratio; pages with an error do not count. probe has error (null: none)."""
    good = F.col("error").isNull()
    s = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0))
    out = probe.groupBy("doc_id").agg((F.count_if(good) > 0).alias("valid"), s("tables").alias("tables"), s("formulas").alias("formulas"), s("text_regions").alias("text_regions"))
    hard = F.col("tables") + F.col("formulas")
    return out.withColumn("ratio", F.coalesce(F.try_divide(hard.cast("double"), hard + F.col("text_regions")), F.lit(0.0)))


def decide(docs: DataFrame, limit: int = 0, ratio: float = RATIO) -> DataFrame:
    """docs (engine, total, valid, ratio) with route, reason, hint: what is asked for, then a failed probe, the page limit, complexity."""
    r, auto = F.col("ratio"), ~F.col("engine").isin("vision", "local")
    many = (F.lit(limit) > 0) & (F.col("total") > limit)
    reason = F.when(~auto, "asked for").when(~F.col("valid"), "no probe").when(many, "too many pages").when(r > ratio, "complex").otherwise("simple")
    route = F.when(~auto, F.col("engine")).when(F.col("valid") & (many | (r > ratio)), "vision").otherwise("local")
    return docs.withColumn("route", route).withColumn("reason", reason).withColumn("hint", (reason == "simple") & (r >= ratio * NEAR))


def scanned(docs: DataFrame, cache: DataFrame, probed: DataFrame, limit: int = 0, ratio: float = RATIO) -> DataFrame:
    """docs (doc_id, key, engine, total, vision_ok) with probe (cache, fresh or none), valid, ratio, route, reason, hint, used, fell_back.

    cache and probed: key, valid, ratio, seconds. A valid cached result of the
    same key counts and costs no time; else a fresh one. A route to vision that
    does not work out falls back to the local engine, unless vision was asked for.
    """
    one = lambda x, p: x.groupBy("key").agg(*[F.max_by(c, F.struct("valid", "ratio")).alias(f"{p}_{c}") for c in ("valid", "ratio", "seconds")])
    both = docs.join(one(cache, "c"), "key", "left").join(one(probed, "p"), "key", "left")
    hit = F.coalesce("c_valid", F.lit(False))
    both = both.withColumn("probe", F.when(hit, "cache").when(F.col("p_valid").isNotNull(), "fresh").otherwise("none"))
    both = both.withColumn("valid", hit | F.coalesce("p_valid", F.lit(False))).withColumn("ratio", F.coalesce(F.when(hit, F.col("c_ratio")).otherwise(F.col("p_ratio")), F.lit(0.0))).withColumn("probe_seconds", F.when(F.col("probe") == "fresh", F.col("p_seconds")).otherwise(0.0))
    out = decide(both, limit, ratio).drop("c_valid", "c_ratio", "c_seconds", "p_valid", "p_ratio", "p_seconds")
    fell = (F.col("route") == "vision") & ~F.coalesce("vision_ok", F.lit(False)) & (F.col("reason") != "asked for")
    return out.withColumn("fell_back", fell).withColumn("used", F.when(fell, "local").otherwise(F.col("route")))


def candidate(found: DataFrame, least: int = 20, slack: int = 10) -> DataFrame:
    """One candidate a document. found: doc_id, engine (primary, second, fallback), md, score, rebuilt.

    The primary counts with ``least`` characters. The second replaces it with a
    better score, or one less by ``slack`` at most where its characters were
    rebuilt. Otherwise the fallback, if it has ``least`` characters.
    """
    usable = found.filter(F.length("md") >= least)
    first = F.max(F.when(F.col("engine") == "primary", F.col("score"))).over(Window.partitionBy("doc_id"))
    better = (F.col("engine") == "second") & first.isNotNull() & ((F.col("score") > first) | (F.col("rebuilt") & (F.col("score") >= first - slack)))
    rank = F.when(better, 0).when(F.col("engine") == "primary", 1).when(F.col("engine") == "fallback", 2)
    ranked = usable.withColumn("rank", rank).filter("rank is not null")
    return ranked.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank"))).filter("n = 1").drop("n", "rank")


def gate(total: Column, foreground: Column, limit: int = GATE) -> Column:
    """A status for what is too long to wait for; 0 switches it off."""
    return F.when(foreground & (F.lit(limit) > 0) & (total > limit), "E_FOREGROUND_LIMIT")


def workers(cpu: Column, memory: Column, cap: int = 4, budget: int = 2684354560) -> Column:
    by_memory = F.when(memory > 0, F.greatest(F.lit(1), F.floor(memory / budget))).otherwise(cap)
    return F.greatest(F.lit(1), F.least(cpu, F.lit(cap), by_memory))


def eta(total: Column, n: Column, per_page: float = SECONDS) -> Column:
    """Seconds before a run: pages by workers, and 40 to start several."""
    w = F.greatest(n, F.lit(1))
    return F.when(total > 0, F.ceil(total * per_page / w) + F.when(w > 1, 40).otherwise(0))


def eta_left(mean: Column, done: Column, total: Column, n: Column) -> Column:
    """Seconds left by the pages so far; null without any."""
    left = F.greatest(total - done, F.lit(0))
    return F.when(mean.isNull() | (total <= 0), None).when(left == 0, 0).otherwise(F.ceil(left * mean / F.greatest(n, F.lit(1))))
