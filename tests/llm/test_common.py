from pathlib import Path

from pagewright.llm.common import dropped, written


def test_written_tables_have_no_checksum_files(spark):
    rows = written(spark.range(0, 100, 1, 4), "plain")
    names = [p.name for p in Path(rows.written_to.removeprefix("file:")).iterdir()]
    assert sum(n.endswith(".parquet") for n in names) == 4
    assert not any(n.endswith(".parquet.crc") for n in names)  # Hadoop starts a process for each
    assert rows.count() == 100
    dropped(rows)
    assert not Path(rows.written_to.removeprefix("file:")).exists()
