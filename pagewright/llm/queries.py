"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, images, licenses, pieces, pii, quality, simhash, substring_dedup, url_filter, warc
from .common import shared_path, table


#: The model file whose pieces op1 and the pipeline use.
PIECES = os.environ.get("PAGEWRIGHT_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Segmentations of a text that op1 returns.
N_BEST = 5


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The N_BEST segmentations of each text, decoded again."""
    return pieces.segmentations(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(PIECES), N_BEST, 250_000)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages have no fetch day and there is no list: both are derived from ids and hosts, spread over a year."""
    pages = table(spark, sf_dir, "pages")
    day0 = F.lit("2024-01-01").cast("date")
    captures = pages.select("page_id", "url", F.date_add(day0, (F.col("page_id") * 37 % 366).cast("int")).alias("day"))
    name = url_filter.host(F.col("url"))
    hosts = pages.select(name.alias("host")).distinct().withColumn("m", F.md5("host"))
    n = lambda i, k: F.conv(F.substring("m", i, k), 16, 10).cast("int")
    entry = lambda lst, value, action, shift: F.struct(F.lit(lst).alias("list"), value.alias("value"), F.lit(action).alias("action"), F.date_add(day0, n(2, 2) + shift).alias("day"))
    base = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)\z", 1)
    rows = F.when(n(1, 1) < 5, F.array(entry("hosts", F.col("host"), "add", 0), entry("hosts", F.col("host"), "remove", 60), entry("hosts", F.col("host"), "add", 120)))
    rows = rows.when(n(1, 1) < 8, F.array(entry("domains", base, "add", 0))).when(n(1, 1) < 11, F.array(entry("paths", F.concat("host", F.lit("/fr/")), "add", 0), entry("paths", F.concat("host", F.lit("/fr/")), "remove", 90)))
    entries = hosts.select(F.explode(rows).alias("e")).select("e.*")
    return url_filter.judged(captures, entries).withColumn("day", F.col("day").cast("string"))


OP2_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 366)::INT AS day, regexp_replace(lower(regexp_extract(url, '//([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '//[^/?#]*/([^/?#]+)/', 1) AS seg FROM pages),
h AS (SELECT *, ('0x' || substr(m, 1, 1))::INT AS k, DATE '2024-01-01' + ('0x' || substr(m, 2, 2))::INT AS d0 FROM (SELECT DISTINCT host, md5(host) AS m FROM p)),
iv AS (
  SELECT 'hosts' AS list, host AS value, d0 AS since, d0 + 60 AS until FROM h WHERE k < 5 UNION ALL SELECT 'hosts', host, d0 + 120, NULL FROM h WHERE k < 5
  UNION ALL SELECT 'domains', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), min(d0), NULL FROM h WHERE k BETWEEN 5 AND 7 GROUP BY 2
  UNION ALL SELECT 'paths', host || '/fr/', d0, d0 + 90 FROM h WHERE k BETWEEN 8 AND 10),
keys AS (
  SELECT page_id, day, host AS value FROM p UNION SELECT page_id, day, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM p UNION SELECT page_id, day, host || '/' || seg || '/' FROM p WHERE seg <> ''),
hit AS (SELECT k.page_id, iv.list, k.value FROM keys k JOIN iv ON iv.value = k.value AND k.day >= since AND (until IS NULL OR k.day < until)),
agg AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM hit GROUP BY page_id)
SELECT p.page_id, p.day::VARCHAR AS day, coalesce(n, 0)::BIGINT AS n_hits, coalesce(lists, '') AS lists, n IS NULL AS keep FROM p LEFT JOIN agg USING (page_id)
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _op3_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(v)}, {quoted(k)})" for k, v in licenses.SENTENCES.items())
    rules = ", ".join(f"({quoted(k)}, {quoted(lic)}, [{', '.join(map(quoted, ids))}])" for k, (lic, ids) in licenses.RULES.items())
    norm = "trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, name in licenses.NAMES:
        norm = f"regexp_replace({norm}, {quoted(pattern)}, {quoted(name)})"
    return rf"""
WITH RECURSIVE known(norm, sentence) AS (VALUES {known}), rules(rule, licence, ids) AS (VALUES {rules}),
parts AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(replace(text, chr(13), ''), '{licenses.BLANK}', chr(1), 'g'), '{licenses.END}', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '[A-Za-z0-9]')) AS s FROM documents),
each AS (SELECT doc_id, unnest(s) AS whole, unnest(range(len(s))) AS place FROM parts),
cut AS (SELECT doc_id, place, CASE WHEN contains(whole, chr(10)) THEN list_prepend(whole, string_split(whole, chr(10))) ELSE [whole] END AS xs FROM each),
lines AS (SELECT doc_id, place, unnest(xs) AS x, unnest(range(len(xs))) AS part FROM cut),
hit AS (SELECT DISTINCT doc_id, place, part, sentence FROM (SELECT doc_id, place, part, {norm} AS norm FROM lines) JOIN known USING (norm)),
walk AS (
  SELECT doc_id, rule, licence, ids, place AS first, place, part, 1 AS step FROM hit, rules WHERE sentence = ids[1]
  UNION
  SELECT w.doc_id, rule, licence, ids, first, h.place, h.part, step + 1 FROM walk w JOIN hit h ON h.doc_id = w.doc_id AND h.sentence = ids[step + 1] AND (h.place > w.place OR h.place = w.place AND h.part > w.part) AND h.place - w.place <= {licenses.GAP + 1}),
ok AS (SELECT doc_id, rule, licence, first, place AS last FROM walk WHERE step = len(ids)),
least AS (SELECT doc_id, licence, rule, first, min(last) AS last FROM ok GROUP BY ALL)
SELECT doc_id, licence, rule, first::INT AS first, last::INT AS last FROM least a
WHERE NOT EXISTS (SELECT 1 FROM least b WHERE b.doc_id = a.doc_id AND b.first <= a.first AND b.last >= a.last AND b.last - b.first > a.last - a.first)
  AND NOT (rule = 'proprietary' AND EXISTS (SELECT 1 FROM least b WHERE b.doc_id = a.doc_id AND b.rule <> 'proprietary'))
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("text")


def op6_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings have no pictures: each row's is drawn from a vector, and some rows get an edited copy of another's (see images.drawn)."""
    return images.copies(images.drawn(table(spark, sf_dir, "embeddings")), every=20)


#: Key of the surrogates that the queries make; others pass their own.
PII_KEY = "pagewright"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", pii.counts(F.col("text")).alias("n_entities"))
    return pii.replace(docs, PII_KEY)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.links(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.read(spark, path, payloads=False).filter("kind = 'record'")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP9_SQL = """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
parts AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(hex, (g * 5 + 1)::INT, 5))::INT) AS p FROM rows),
named AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
    array_to_string(list_transform(p, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') AS payload_digest
  FROM parts),
best AS (SELECT payload_digest, max(page_id) AS first FROM named GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM named JOIN best USING (payload_digest)
"""

OP10_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM docs),
windows AS (
  SELECT doc_id, pos, w, CASE WHEN count(*) OVER x = 20 THEN string_agg(w, ' ') OVER x END AS seq
  FROM words WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
judged AS (
  SELECT *, CASE WHEN seq IS NOT NULL AND row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS again FROM windows),
covered AS (
  SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged),
summed AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(w, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN summed USING (doc_id)
"""


def queries() -> dict:
    found = [op1_sentencepiece, op2_url_filter, op3_licenses, op4_quality, op5_simhash, op6_images, op7_pii, op8_decontaminate, op9_warc, op10_substring_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op3_licenses": _op3_sql(), "op9_warc": OP9_SQL, "op10_substring_dedup": OP10_SQL}
