"""Derived views over the driver's tables: the same definition for Spark and, as a common table expression, for DuckDB.

The tables hold plain prose, so that most document rules would find nothing in
them. The views give lines, pages, tables, ideographic lines, boxes, glyphs,
page events and a file manifest on which every rule fires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One fixed ideograph for each letter a to z.
IDEOGRAPHS = "天地人日月山水火土金木石田目口手足心力大小上下中文字"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EXTENSIONS = ("pdf", "docx", "xlsx", "doc", "xls", "gif", "docm", "epub", "md", "txt", "xyz", "", "log", "text")

#: Tables in braces; ``//`` is whole division.
VIEWS = {
    "doc_pages": """
SELECT conv_id AS doc_id, turn + 1 AS page_no, turn // 2 AS batch, text AS body FROM {conversations}
UNION ALL SELECT conv_id, 101, 50, CASE WHEN conv_id % 2 = 0 THEN 'tiny' ELSE text END FROM {conversations} WHERE turn = 0 AND conv_id % 3 <> 0""",
    "wanted_pages": """
SELECT conv_id AS doc_id, turn + 1 AS page_no, turn // 2 AS batch FROM {conversations}
UNION ALL SELECT conv_id, 101, 50 FROM {conversations} WHERE turn = 0""",
    "header_pages": """
SELECT doc_id, page_no, CASE WHEN page_no % 5 <> 0 THEN concat('HDR ', CAST(doc_id AS STRING), chr(10), body) ELSE body END || CASE WHEN page_no % 3 = 1 THEN concat(chr(10), CAST(page_no AS STRING), ' / 13') ELSE '' END AS body FROM {doc_pages}""",
    "table_rows": """
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT l_orderkey AS doc_id,
    2 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no,
    concat('| ', CAST(l_linenumber AS STRING), ' | ', CASE WHEN l_returnflag = 'R' THEN ' ' ELSE l_returnflag END, ' | ',
           CASE WHEN l_discount < 0.02 THEN '0.00' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END, ' |') AS line
  FROM {lineitem}
  UNION ALL SELECT DISTINCT l_orderkey, 1, '| n | flag | qty |' FROM {lineitem}
  UNION ALL SELECT DISTINCT l_orderkey, 2, '| --- | --- | --- |' FROM {lineitem}) AS t""",
    "noise_table_rows": """
SELECT doc_id, line_no, CASE WHEN line_no > 2 THEN concat('|', substr(line, strpos_(substr(line, 2), '|') + 2)) ELSE line END AS line FROM {table_rows}""",
    "boxes": """
SELECT page_no, box_id, x1, y1, x1 + w AS x2, y1 + h AS y2, score, label FROM (
  SELECT vec_id // 20 AS page_no, vec_id AS box_id,
    CAST(floor(500 + 1000 * CAST({at1} AS DOUBLE)) AS BIGINT) AS x1, CAST(floor(500 + 1000 * CAST({at2} AS DOUBLE)) AS BIGINT) AS y1,
    20 + CAST(floor(1600 * abs(CAST({at3} AS DOUBLE))) AS BIGINT) AS w, 10 + CAST(floor(800 * abs(CAST({at4} AS DOUBLE))) AS BIGINT) AS h,
    abs(CAST({at5} AS DOUBLE)) AS score, CAST(label AS BIGINT) AS label
  FROM {embeddings}) AS b""",
    "ocr_events": """
SELECT user_id AS doc_id, event_id AS seq, 1 + (event_id * 7919) % 40 AS page_no,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, value AS duration, event_type AS kind
FROM {events}""",
    "probe": """
SELECT doc_id, page_no, count(CASE WHEN kind = 'purchase' THEN 1 END) AS tables, count(CASE WHEN kind = 'click' THEN 1 END) AS formulas,
       count(CASE WHEN kind NOT IN ('purchase', 'click', 'error') THEN 1 END) AS text_regions,
       max(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS bad
FROM {ocr_events} GROUP BY doc_id, page_no""",
    "manifest": """
SELECT doc_id, concat('in/d', CAST(doc_id % 7 AS STRING), '/', CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END, 'File', CAST(doc_id AS STRING),
         CASE WHEN ext = '' THEN '' ELSE concat('.', CASE WHEN doc_id % 2 = 0 THEN upper(ext) ELSE ext END) END) AS path,
       n_chars AS size
FROM (SELECT doc_id, n_chars, CASE doc_id % 14 """
    + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS))
    + """ END AS ext FROM {documents}) AS m""",
    "doc_lines": "",
    "cjk_lines": f"""
SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 AND (line LIKE '%.' OR line LIKE '%,') THEN substr(line, 1, length(line) - 1) ELSE line END AS line
FROM (SELECT doc_id, line_no, translate(lower(line), '{LETTERS}', '{IDEOGRAPHS}') AS line FROM {{doc_lines}}) AS c""",
}
_DOC_LINES = "SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"


def _names(sql: str) -> list[str]:
    import re

    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if not n.startswith("at")]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver or a view of VIEWS."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "doc_lines":
        from pyspark.sql import functions as F

        found = view(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
        return found.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")
    sql = VIEWS[name].replace("//", "div").replace("strpos_(", "instr(")
    for i in range(1, 6):
        sql = sql.replace(f"{{at{i}}}", f"element_at(embedding, {i})")
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _names(sql)})


def cte(*names: str) -> str:
    """WITH ... for DuckDB, with all that the views need."""
    out: dict[str, str] = {}

    def add(name):
        if name not in VIEWS or name in out:
            return
        sql = VIEWS[name] or _DOC_LINES
        for n in _names(sql):
            add(n)
        for n in _names(sql):
            sql = sql.replace(f"{{{n}}}", n)
        for i in range(1, 6):
            sql = sql.replace(f"{{at{i}}}", f"embedding[{i}]")
        out[name] = sql.replace("strpos_(", "strpos(")

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in out.items())
