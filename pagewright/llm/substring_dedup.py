"""Substring dedup with difference-cover anchors (operator 10).

A window is ``window`` consecutive words of one document. A word goes if some
window that covers it has a word sequence that also starts earlier (smaller
doc_id, or same document and smaller start).

Two equal windows that start at i and j share an aligned anchor: the offsets
{0, 1, 3, 9} form a difference cover modulo 13, so for some k < 13 both i + k
and j + k are cover positions, and an anchor of window - 12 words fits behind
k. Only anchors at cover positions (4 of 13) are hashed and dealt out.

1. Each task merges the anchors of up to FLUSH words' worth of text before it
   deals them out by hash: one row for each different anchor, and anchors that
   meet here are known to be shared. Those that meet after the shuffle follow.
2. Shared anchors are extended: the windows around them, and no others, get a
   96-bit hash. Again each task keeps the earliest start of each hash and marks
   the others at once; the shuffle by hash then leaves one earliest start.

No group is gathered in a task: a hash that very many documents hold has one
row for each flush of each task, and these rows stream through a sort. Texts
travel between steps as zstandard frames.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, window_hashes, word_hashes, words_of, written

#: A perfect difference cover and its period.
COVER, PERIOD = (0, 1, 3, 9), 13
#: Multipliers of the window hashes: anchors, then the two parts of a full window's hash.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Rows gathered and merged in Python before they are handed to Spark.
FLUSH = 1 << 19


def _anchor_positions(n: int, length: int) -> np.ndarray:
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    m = max(0, n - length + 1)
    return np.flatnonzero(np.resize(on, m)) if m else np.empty(0, np.int64)


def _anywhere(i: np.ndarray, th: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A key for rows that look for no partner: dealt out evenly, copies of a text too, in the row order of a document, which compresses well."""
    return (i * np.int64(0x9E3779B97F4A7C1)) ^ th ^ (pos >> 10)


def _anchors(window: int):
    """h, id, th, pos, sure: one row for each different anchor of a flush, sure ones also for its further places."""
    length = window - PERIOD + 1
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("sure", pa.bool_())])

    def flush(cols):
        h, i, th, pos = (np.concatenate(cols[k]) for k in ("h", "id", "th", "pos"))
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        extra, sure = np.zeros(len(h), bool), np.zeros(len(h), bool)
        extra[order[1:]] = same  # not the first of its hash
        sure[order[1:]] = same
        sure[order[:-1]] |= same
        h = np.where(extra, _anywhere(i, th, pos), h)
        return batches({"h": [h], "id": [i], "th": [th], "pos": [pos.astype(np.int32)], "sure": [sure]}, schema)

    def run(it):
        cols, held = {k: [] for k in ("h", "id", "th", "pos")}, 0
        for batch in it:
            for i, th, text in zip(*(batch.column(k).to_pylist() for k in ("id", "th", "text"))):
                words = words_of(text)
                if len(words) < window:
                    continue
                at = _anchor_positions(len(words), length)
                cols["h"].append(window_hashes(word_hashes(words), length, MULTIPLIERS[0])[at].view(np.int64))
                cols["id"].append(np.full(len(at), i, np.int64))
                cols["th"].append(np.full(len(at), th, np.int64))
                cols["pos"].append(at)
                held += len(at)
                if held >= FLUSH:
                    yield from flush(cols)
                    cols, held = {k: [] for k in cols}, 0
        if held:
            yield from flush(cols)

    return run


def _windows(window: int):
    """h1, h2, id, th, pos, sure: the windows that contain a shared anchor, the earliest of each hash in a flush and, surely later, the others."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("sure", pa.bool_())])

    def flush(cols):
        h1, h2, i, th, pos = (np.concatenate(cols[k]) for k in ("h1", "h2", "id", "th", "pos"))
        order = np.lexsort((pos, th, i, h2, h1))
        same = np.concatenate([[False], (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])])
        start = np.empty(len(h1), np.int64)  # of each row's group: the row at the earliest place
        start[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(h1))))]
        first = (i == i[start]) & (th == th[start]) & (pos == pos[start])
        keep = ~first | (start == np.arange(len(h1)))  # without repeated rows of the first
        h1 = np.where(first, h1.view(np.int64), _anywhere(i, th, pos))
        h2 = np.where(first, h2, 0).astype(np.int32)
        return batches({"h1": [h1[keep]], "h2": [h2[keep]], "id": [i[keep]], "th": [th[keep]], "pos": [pos[keep].astype(np.int32)], "sure": [~first[keep]]}, schema)

    def run(it):
        cols, held = {k: [] for k in ("h1", "h2", "id", "th", "pos")}, 0
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in it:
            for i, th, packed, shared in zip(*(batch.column(k).to_pylist() for k in ("id", "th", "packed", "shared"))):
                h = word_hashes(unpack(packed).split())
                m = len(h) - window + 1
                if m <= 0:
                    continue
                shared = np.asarray(shared, np.int64)
                edge = np.zeros(m + 1, np.int64)  # a window at p holds the anchors at p .. p + PERIOD - 1
                np.add.at(edge, np.maximum(shared - PERIOD + 1, 0), 1)
                np.add.at(edge, np.minimum(shared + 1, m), -1)
                at = np.flatnonzero(np.cumsum(edge[:m]) > 0)
                cols["h1"].append(window_hashes(h, window, MULTIPLIERS[1])[at])
                cols["h2"].append(window_hashes(h, window, MULTIPLIERS[2])[at].view(np.int32)[::2])
                cols["id"].append(np.full(len(at), i, np.int64))
                cols["th"].append(np.full(len(at), th, np.int64))
                cols["pos"].append(at)
                held += len(at)
                if held >= FLUSH:
                    yield from flush(cols)
                    cols, held = {k: [] for k in cols}, 0
        if held:
            yield from flush(cols)

    return run


def _pack(it):
    """Texts as zstandard frames of their UTF-8, an empty frame for null."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in it:
        frames = pa.array([pack(t.encode("utf-8", "surrogatepass") if t else b"") for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), frames], names=["id", "th", "packed"])


def _cut(window: int):
    """Remove the words under repeated windows."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("kept_sha256", pa.string())])

    def run(it):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in it:
            rows, size = [], 0
            for i, packed, again in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "packed", "again"))):
                words = unpack(packed).split()
                gone = np.zeros(len(words) + 1, np.int64)
                if again:
                    at = np.asarray(again, np.int64)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone)[: len(words)] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if again else b" ".join(words)
                rows.append((i, len(words), int(gone.sum()), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
                size += len(kept)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, text (what is kept, words joined by a space), kept_sha256.

    docs: doc_id (integer), text; other columns are ignored, whatever their
    names. Null or empty text: no words. Null doc_id: counts as smaller than
    any other. Rows that repeat a doc_id and its text are one place: they are
    not earlier than each other and get the same result; rows that share a
    doc_id with other text are ordered by a hash of the text. Texts shorter
    than a window stay whole. Empty table: empty result.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must be over {PERIOD}")
    low = F.lit(-(2**63))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.select("text", F.coalesce("doc_id", low).alias("id"), F.xxhash64("text").alias("th"))
    texts = keyed.select("id", "th", "text")
    anchors = texts.mapInArrow(_anchors(window), "h long, id long, th long, pos int, sure boolean")
    by = Window.partitionBy("h").orderBy("id", "th", "pos")
    met = F.col("sure") | F.lag("h").over(by).isNotNull() | F.lead("h").over(by).isNotNull()
    shared = written(anchors.withColumn("met", met).filter("met").groupBy("id", "th").agg(F.collect_set("pos").alias("shared")), "shared")
    packed = texts.mapInArrow(_pack, "id long, th long, packed binary")
    hashed = packed.hint("merge").join(shared, ["id", "th"]).select("id", "th", "packed", "shared")
    hashed = hashed.mapInArrow(_windows(window), "h1 long, h2 int, id long, th long, pos int, sure boolean")
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy("id", "th", "pos"))  # rows of one place share a rank
    later = hashed.withColumn("place", place).filter("sure or place > 1")
    later = written(later.groupBy("id", "th").agg(F.collect_set("pos").alias("again")), "later")
    done = packed.join(later.hint("merge"), ["id", "th"], "left").select(F.when(F.col("id") != low, F.col("id")).alias("doc_id"), "packed", "again")
    return done.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, text string, kept_sha256 string")
