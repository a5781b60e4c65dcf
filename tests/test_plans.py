"""Plans at a glance: pruned scans, no joins without an equal key, Python only where a format needs it."""

import re

import pytest

from pagewright import catalog

SF = "/root/testdata/sf0.001"
#: Queries whose rule runs in Python, by Arrow batches.
PYTHON = {"decode_text", "html_text", "html_links", "html_headings", "inline_links", "heading_rebuild"}


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_plan(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert not re.search("CartesianProduct|NestedLoopJoin", text)
    assert bool(re.search("Python|Arrow|Pandas", text)) == (name in PYTHON)


def test_scans_are_pruned(spark):
    schemas = lambda name: re.findall(r"ReadSchema: struct<([^>]*)>", plan(catalog.queries()[name](spark, SF)))
    assert schemas("coverage") and all("text" not in s for s in schemas("coverage"))
    assert all(s == "doc_id:bigint" for s in schemas("page_gate"))
    assert all("url" in s and "html" not in s for s in schemas("url_tail"))
