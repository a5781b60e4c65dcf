"""SimHash near-duplicates with pigeonring filtering (operator 5).

Two 64-bit fingerprints link at d or fewer differing bits. The fingerprint is a
ring of m = 3 d + 1 segments. If two fingerprints differ in d bits at most,
then from some segment on every chain of l consecutive segments differs in no
more than l d / m bits (the pigeonring principle). For l = 3 that is less than
one bit, so three consecutive segments are equal: they are the join key. Longer
chains must stay within their budgets too, before the full Hamming check.

Equal fingerprints are one node. A key that more than ``small`` nodes share is
not paired: there, each node is dealt to all points within distance 1 (d = 2;
for other d see _stars), and the nodes that meet at a point, at most 65 and all
within d of each other, are linked to the smallest. Two nodes within d meet at
some point, so no link between components is lost, and the work grows with the
nodes, not with the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SEED, kept_rows, salted_join, words_of, written
from .components import components

BITS = 64
CHUNK = 1 << 14


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; no words: 0."""
    words = words_of(text.lower() if text and text.isascii() else text)
    if text and not text.isascii():
        words = [w.lower() for w in words]  # bytes.lower() maps A-Z alone
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, counts, h, join = len(words) - shingle + 1, np.zeros(BITS, np.int64), xxhash.xxh64_intdigest, b" ".join
    for i in range(0, n, CHUNK):
        each = np.fromiter((h(join(words[j : j + shingle]), SEED) for j in range(i, min(n, i + CHUNK))), dtype=">u8")
        counts += np.unpackbits(each.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, th (a hash of the text), fp (the 64 bits as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])

    def run(it):
        for batch in it:
            fp = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fp.view(np.int64))], schema=schema)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def ring(d: int) -> list[list[int]]:
    """masks[i][l - 1]: the bits of the chain of l segments that starts at segment i."""
    m = 3 * d + 1
    cuts = [round(BITS * k / m) for k in range(m + 1)]
    own = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(m)]
    chains = []
    for i in range(m):
        mask, row = 0, []
        for k in range(m):
            mask |= own[(i + k) % m]
            row.append(mask)
        chains.append(row)
    return chains


def _differing(mask: int | None = None):
    x = F.col("a").bitwiseXOR(F.col("b"))
    return F.bit_count(x if mask is None else x.bitwiseAND(F.lit(_signed(mask))))


def _stars(hot: DataFrame, d: int) -> DataFrame:
    """Links of nodes that share a key held by many: nodes that meet at a point are within d of each other."""
    bits = F.array(*[F.lit(_signed(1 << b)) for b in range(BITS)])
    free = F.filter(bits, lambda b: b.bitwiseAND(F.col("mask")) == 0)  # equal on the key, so they differ elsewhere
    flips = lambda x: F.transform(free, lambda b: x.bitwiseXOR(b))
    if d == 2:
        points = F.transform(F.array_append(flips(F.col("fp")), F.col("fp")), lambda z: F.struct(F.lit(0).cast("long").alias("bit"), z.alias("z")))
    else:  # d = 1: one bit is left out; d = 3: and one more may differ from the point
        cleared = F.transform(free, lambda b: F.struct(b.alias("bit"), F.col("fp").bitwiseAND(F.bitwise_not(b)).alias("z")))
        points = cleared if d == 1 else F.flatten(F.transform(cleared, lambda c: F.array_append(F.transform(F.filter(free, lambda b: b != c["bit"]), lambda b: F.struct(c["bit"].alias("bit"), c["z"].bitwiseXOR(b).alias("z"))), c)))
    met = hot.select("i", "key", "fp", F.explode(points).alias("at")).select("i", "key", "fp", "at.bit", "at.z")
    w = Window.partitionBy("i", "key", "bit", "z")  # at most 65 rows
    return met.withColumn("b", F.min("fp").over(w)).filter("fp <> b").select(F.col("fp").alias("a"), "b")


def links(nodes: DataFrame, d: int = 2, small: int = 64) -> DataFrame:
    """nodes: distinct fp -> links (a, b) that join the same components as all pairs within d."""
    if d not in (1, 2, 3):
        raise ValueError("d must be 1, 2 or 3")
    chains = ring(d)
    m = len(chains)
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(chains[i][2])).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(chains[i][2]))).alias("key")) for i in range(m)])
    keyed = nodes.select("fp", F.explode(at).alias("x")).select("fp", "x.i", "x.mask", "x.key")
    shared = keyed.groupBy("i", "key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = written(salted_join(keyed, shared, ["i", "key"], "fp"), "keyed")
    few = keyed.filter(F.col("n") <= small).select("i", "key", "fp")
    pairs = few.withColumnRenamed("fp", "a").hint("merge").join(few.withColumnRenamed("fp", "b"), ["i", "key"]).filter("a > b")
    within = F.lit(False)
    for i in range(m):
        budget = F.col("i") == i
        for length in range(4, m + 1):
            budget &= _differing(chains[i][length - 1]) <= length * d // m
        within |= budget
    pairs = pairs.filter(within).filter(_differing() <= d).select("a", "b")
    return pairs.unionByName(_stars(keyed.filter(F.col("n") > small), d)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, d: int = 2, small: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row per input row.

    Null and empty texts, and texts without words, have fingerprint zero and
    link like any other. Null doc_id: the row is kept and takes part, but is
    never a component_id (null where a component has no other). Repeated rows
    are repeated in the result. Other columns of docs are ignored. Empty table:
    empty result.
    """
    marked, rooted = _rooted(docs, shingle, d, small)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = salted_join(rooted, least, ["root"], "fp").select("fp", "component_id")
    return salted_join(marked, named, ["fp"], "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(docs: DataFrame, shingle: int, d: int, small: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp of every row; fp, least doc_id, root of every different fingerprint)."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), d, small))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    return marked, written(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")


def groups(docs: DataFrame, shingle: int = 3, d: int = 2, small: int = 64) -> DataFrame:
    """th (the hash of a text), root of its component: one row for each different text."""
    marked, rooted = _rooted(docs, shingle, d, small)
    return written(salted_join(marked.select("th", "fp").distinct(), rooted.select("fp", "root"), ["fp"], "th").select("th", "root"), "groups")


def keep_one(docs: DataFrame, shingle: int = 3, d: int = 2, small: int = 64) -> DataFrame:
    """One row of each component of near_duplicates(), all columns: the smallest doc_id, null last, then the smallest hash of the text.

    Rows that repeat both are one.
    """
    marked, rooted = _rooted(docs, shingle, d, small)
    keepers = marked.join(rooted.select("fp", "root").hint("merge"), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
    return kept_rows(docs, keepers)
