"""Every query against its SQL on the driver's smallest tables, and that its rule finds something."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from pagewright import catalog
from pagewright.fixtures import VIEWS, cte, view

SF = os.environ.get("PAGEWRIGHT_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if pd.isna(v):
            return ""
        return str(round(float(v), 6)) if isinstance(v, float) or hasattr(v, "__float__") and not isinstance(v, (str, bool)) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", [v for v in VIEWS])
def test_views_agree(spark, duck, name):
    assert plain(view(spark, SF, name).toPandas()) == plain(duck.execute(f"{cte(name)} SELECT * FROM {name}").df())


def test_rules_fire(spark):
    """What would prove nothing on prose must change something on the derived views."""
    q = catalog.queries()
    fires = {
        "mojibake_scan": "accents > 0", "cjk_collapse": "removed > 0", "br_downgrade": "br_tags > 0 and removed > 0", "join_wrapped": "joined > 0", "cn_heading_level": "level is not null", "noise_rows": "removed > 0", "table_shape": "bad_rows > 0",
        "doc_quality": "suggest_vision", "split_row_merge": "merged > 0", "wrap_metric": "wraps > 0", "skip_reason": "reason is not null", "route_decision": "route = 'vision'", "page_spec_parse": "error is not null", "heading_rebuild": "level is not null", "crop_plan": "state = 'over limit'",
    }
    for name, rule in fires.items():
        df = q[name](spark, SF)
        assert 0 < df.filter(rule).count() < df.count(), name


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert "score" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
