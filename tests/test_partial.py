"""Queries against their SQL where rows lack what the smallest tables have: boxes of a page (the last one of a table, when its rows are no multiple of 20), characters of a text."""

import duckdb

from pagewright import catalog
from pagewright.operators import geometry as G

from .test_catalog import SF, plain


def both(spark, folder, name, table, rows):
    """Plain results of a query and of its SQL over one table, made of rows (SQL for DuckDB)."""
    con = duckdb.connect()
    con.execute(f"copy ({rows}) to '{folder}/{table}.parquet'")
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return plain(catalog.queries()[name](spark, str(folder)).toPandas()), plain(con.execute(catalog.oracle_sql()[name]).df())


#: Pages of 1 to 19 boxes cut at their end, as many with holes, and whole ones.
CUT = f"""WITH e AS (SELECT vec_id + 500 * k AS vec_id, embedding, label FROM '{SF}/embeddings.parquet', range(2) AS t(k) WHERE vec_id < 500)
SELECT * FROM e WHERE CASE WHEN vec_id // 20 < 20 THEN vec_id % 20 < vec_id // 20 WHEN vec_id // 20 < 40 THEN vec_id * 7 % 20 < vec_id // 20 - 20 ELSE true END"""


def test_column_bins(spark, tmp_path):
    got, want = both(spark, tmp_path, "column_bins", "embeddings", CUT)
    assert got == want


def test_reading_order(spark, tmp_path):
    got, want = both(spark, tmp_path, "reading_order", "embeddings", CUT)
    assert got == want


def test_structure_widths(spark, tmp_path):
    got, want = both(spark, tmp_path, "structure_widths", "embeddings", CUT)
    assert got == want and len(got) == 10


def test_few_boxes_are_one_column(spark):
    """The rule itself is as before: what is left of a sheet shows no columns."""
    boxes = spark.createDataFrame([(0, 1, i, 520 * (i % 2), 40 * i, 520 * (i % 2) + 400, 40 * i + 29) for i in range(1, 4)], "doc_id long, page_no long, box_id long, x1 long, y1 long, x2 long, y2 long")
    pages = spark.createDataFrame([(0, 1, 1000)], "doc_id long, page_no long, page_w int")
    assert {(r.col, r.multi) for r in G.columns(boxes, pages).collect()} == {(0, False)}
    assert [r.box_id for r in G.reading_order(boxes, pages).orderBy("place").collect()] == [1, 2, 3]


def test_edit_distance_of_unprintable_texts(spark, tmp_path):
    texts = ["", None, "é", "Éé\n中", "\t\r\n", "é.", "a", "añb", " ", "ab" * 60]
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, " + ("NULL" if t is None else " || ".join(f"chr({ord(c)})" for c in t) or "''") + " AS text" for i, t in enumerate(texts))
    got, want = both(spark, tmp_path, "edit_distance", "documents", rows)
    assert got == want and len(got) == 5
