"""Benchmark decontamination with spaced seeds (operator 8).

A seed is a fixed mask over token positions; tokens at its zeros are ignored.
The hashes of all seeds of the test items form a table; every position of every
training text is looked up in it. Around each hit the texts are compared token
by token along the hit's diagonal: text and item overlap if some WINDOW
consecutive item tokens have at least LEAST equal ones (an item shorter than a
window must match as a whole).

The two masks are chosen so that no placement of WINDOW - LEAST substitutions
in WINDOW tokens escapes both (a test goes through all placements), so seeds
lose nothing that the rule calls an overlap.

The table goes to the executors by broadcast, in blocks: test items are dealt
into as many blocks as keep each within BLOCK_CHARS, and each block is held
against all texts. The texts are never shuffled, so a passage that very many
texts share costs nothing more than its rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEED, dropped, written

#: Fixed values of the rule: at most 20 % substitutions in 13 tokens, and the masks that find them all.
WINDOW, LEAST = 13, 11
MASKS = ("11101011", "11001111")
#: Items with fewer tokens are no evidence of a leak and are not searched.
LEAST_TOKENS = 5
#: Characters of test items in one broadcast block.
BLOCK_CHARS = 16_000_000
HIT = "array<struct<item_id:long,n_matched:int,start:int,stop:int>>"
HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("n_matched", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
_TOKEN = re.compile(r"\w+")
_BITS = 22


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased word tokens."""
    h, found = xxhash.xxh64_intdigest, _TOKEN.findall(text.lower()) if text else []
    return np.fromiter((h(w.encode("utf-8", "surrogatepass"), SEED) for w in found), dtype=np.uint64, count=len(found))


def _masks(lengths) -> list[tuple[int, np.ndarray]]:
    """(salt, offsets): the two masks, and a solid one for each length of items that are shorter."""
    spaced = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]
    return list(enumerate(spaced)) + [(8 + n, np.arange(n)) for n in sorted(set(lengths)) if LEAST_TOKENS <= n < len(MASKS[0])]


def _seeds(h: np.ndarray, salt: int, offsets: np.ndarray) -> np.ndarray:
    m = len(h) - int(offsets[-1])
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, salt + 1, np.uint64)
    with np.errstate(over="ignore"):
        for o in offsets:
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[o : o + m]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


class Table:
    """The seeds of one block of test items, sorted by hash, with a bitmap in front."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, h) for i, h in ((i, tokens(t)) for i, t in items) if len(h) >= LEAST_TOKENS]
        self.masks = _masks(len(h) for _, h in self.items)
        seeds, which, at = [], [], []
        for k, (_, h) in enumerate(self.items):
            for salt, offsets in self.masks:
                if salt >= 8 and len(h) != salt - 8:
                    continue
                s = _seeds(h, salt, offsets)
                seeds.append(s)
                which.append(np.full(len(s), k, np.int64))
                at.append(np.arange(len(s)))
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        seeds, which, at = cat(seeds, np.uint64), cat(which, np.int64), cat(at, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.which, self.at = seeds[order], which[order], at[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, text: str | None) -> list[dict]:
        h = tokens(text)
        found = []
        for salt, offsets in self.masks:
            s = _seeds(h, salt, offsets)
            near = np.flatnonzero(self.bitmap[(s >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(near):
                continue
            lo, hi = np.searchsorted(self.seeds, s[near], "left"), np.searchsorted(self.seeds, s[near], "right")
            n = hi - lo
            if n.sum():
                row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.stack([self.which[row], np.repeat(near, n) - self.at[row]], 1))
        best: dict[int, dict] = {}
        for k, diagonal in np.unique(np.concatenate(found), axis=0).tolist() if found else ():
            i, item = self.items[k]
            hit = overlap(h, item, diagonal)
            if hit and (i not in best or hit[0] > best[i]["n_matched"]):
                best[i] = {"item_id": i, "n_matched": hit[0], "start": hit[1], "stop": hit[2]}
        return [best[i] for i in sorted(best)]


def overlap(h: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(equal tokens, start, stop in h) of the windows of item that match h along a diagonal."""
    n = len(item)
    equal = np.zeros(n, np.int64)
    a, b = max(0, -diagonal), min(n, len(h) - diagonal)
    if b <= a:
        return None
    equal[a:b] = h[a + diagonal : b + diagonal] == item[a:b]
    w = min(n, WINDOW)
    need = LEAST if n >= WINDOW else n
    sums = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(sums[w:] - sums[:-w] >= need)
    if not len(good):
        return None
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, good, 1)
    np.add.at(edge, good + w, -1)
    inside = np.cumsum(edge[:n]) > 0
    at = np.flatnonzero(inside & (equal > 0))
    return int((equal * inside).sum()), int(at[0] + diagonal), int(at[-1] + diagonal + 1)


def _finder(table):
    @F.arrow_udf(HIT)
    def find(t: pa.Array) -> pa.Array:
        return pa.array([table.value.hits(x) for x in t.to_pylist()], HIT_TYPE)

    return find


def _blocks(benchmark: DataFrame, block_chars: int):
    """The test items in blocks of about block_chars characters, one after the other: (how many there are, function from texts to hits).

    A block's broadcast is given up before the next one is made, so that driver
    and workers hold one block at a time, however many items there are.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // block_chars + 1
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).dropDuplicates().collect()  # within block_chars, give or take the hash
        table = spark.sparkContext.broadcast(Table(sorted((-1 if r.item_id is None else r.item_id, r.text) for r in rows)))
        yield n, _finder(table)
        if n > 1:
            table.unpersist()


def links(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_matched (equal tokens), start, stop (tokens of the text): a row for each overlapping pair.

    Of several overlaps with one item the one with most equal tokens counts, the
    first of these in order of position. Null or empty texts and items, and
    items of fewer than LEAST_TOKENS tokens, overlap with nothing. Null doc_id
    stays null; a null item_id is -1. Repeated documents are repeated in the
    result; items that share an id are one item, if they are in one block. Other
    columns are ignored. Empty tables: empty result.
    """
    out = None
    for n, find in _blocks(benchmark, block_chars):
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), find(F.col("text").cast("string")).alias("hits"))
        found = found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.n_matched", "h.start", "h.stop")
        found = written(found, "hits") if n > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, whose text overlaps with no item.

    Null and empty texts overlap with nothing and stay; so do repeated rows.
    Empty tables: docs as they are.
    """
    before = None
    for n, find in _blocks(benchmark, block_chars):
        docs = docs.filter(F.size(find(F.col("text").cast("string"))) == 0)
        if n > 1:
            docs = written(docs, "clean")
            if before is not None:
                dropped(before)
            before = docs
    return docs
