"""What the operators share: written intermediate tables, word hashing and set-up of Arrow output."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seed of every word and shingle hash.
SEED = 42
#: For tables that are read again at once: local files without a checksum file beside each, for which Hadoop starts one process more a file (Parquet's pages have checksums of their own). Other file systems are not concerned.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="pagewright-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the JVM may be gone already
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/pagewright-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    Shuffle files of the finished job are released at once, so that a chain of
    jobs needs the disk of its largest job only.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**PLAIN).parquet(path)
    schema = df.schema
    del df
    release(spark)
    found = spark.read.schema(schema).parquet(path)
    found.written_to = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Remove the files of tables from written() that nothing reads any more, so that a chain of jobs does not add them up."""
    for t in tables:
        _remove(t.sparkSession, t.written_to)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more.

    The first collection lets go of Python's handles, which the JVM hears of a
    little later; the second one finds the plans.
    """
    for wait in (0.4, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """Join with a right side that has one row for each key. A key that very many left rows hold is dealt to ``salts`` tasks by the hash of column ``by``, and both sides come straight from a shuffle, so that Spark can split it further."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    return salted.join(right.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)]))).hint("merge"), [*on, "_salt"], how).drop("_salt")


def hashed_rows(docs: DataFrame) -> DataFrame:
    """row (all columns), id and th (the hash of the text) of each row."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"))


def kept_rows(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows of docs that keepers (k: struct with doc_id and th, the hash of the text) name, each once."""
    keepers = written(keepers.select(F.col("k.doc_id").alias("kept_id"), F.col("k.th").alias("kept_th")), "keepers")
    hashed = hashed_rows(docs)
    on = hashed["id"].eqNullSafe(keepers["kept_id"]) & (hashed["th"] == keepers["kept_th"])
    found = hashed.hint("merge").join(keepers, on, "left_semi")
    return found.dropDuplicates(["id", "th"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the UTF-8 text; bytes.split() splits at just these characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, SEED) for w in words), dtype=np.uint64, count=len(words))


def window_hashes(h: np.ndarray, k: int, multiplier: int) -> np.ndarray:
    """A polynomial hash modulo 2**64 of every k consecutive word hashes, finally mixed."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out, mul = np.zeros(m, np.uint64), np.uint64(multiplier)
    with np.errstate(over="ignore"):
        for j in range(k):
            out *= mul
            out += h[j : j + m]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def batches(columns: dict[str, list[np.ndarray]], schema: pa.Schema, rows: int = 1 << 16):
    """Arrow batches of bounded size from lists of numpy chunks; the lists are emptied."""
    arrays = {k: np.concatenate(v) for k, v in columns.items()}
    for v in columns.values():
        v.clear()
    n = len(next(iter(arrays.values())))
    for i in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([pa.array(arrays[f.name][i : i + rows], type=f.type) for f in schema], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
