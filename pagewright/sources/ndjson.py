"""Page events as lines of JSON, damaged or foreign lines passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "seq long, event string, no long, md string, stats struct<status:string, tables:int, formulas:int, formula_failures:int>, duration double, warnings array<string>, error string"


def parsed(lines: DataFrame, column: str = "line") -> DataFrame:
    """One row for each line that is a JSON object of the right shape; works on streams too."""
    found = lines.select(F.from_json(F.col(column), EVENT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return found.filter("e is not null and e._bad is null and e.event is not null").select("e.*").drop("_bad")
