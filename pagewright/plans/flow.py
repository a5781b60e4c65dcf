"""The whole way of documents: clean, promote, assess, route, write. Each step is a function of a frame; the flow chains them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cjk, paths
from ..operators import tables
from ..operators.lines import exploded, joined


class Flow:
    """docs: doc_id, text (Markdown), any further columns.

    Flow(docs).clean().promote().trim().assess() gives documents with score and
    route beside their clean text; every step is lazy.
    """

    def __init__(self, docs: DataFrame, collapse: bool = True):
        self.docs, self.collapse = docs, collapse

    def _with_text(self, lines: DataFrame) -> Flow:
        text = joined(lines, "doc_id", text="out", as_="text")
        return Flow(self.docs.drop("text").join(text, "doc_id", "left"), self.collapse)

    def clean(self) -> Flow:
        """Broken lines joined, then break tags and injected spaces taken out."""
        if not self.collapse:
            return self
        return Flow(self.docs.withColumn("text", cjk.clean_text(F.col("text"))), self.collapse)

    def promote(self) -> Flow:
        return Flow(self.docs.withColumn("text", cjk.promoted_text(F.col("text"))), self.collapse)

    def trim(self) -> Flow:
        return self._with_text(tables.without_noise(exploded(self.docs)).withColumn("out", F.col("line")))

    def assess(self) -> DataFrame:
        found = tables.scored(tables.signals(exploded(self.docs)))
        return self.docs.join(found, "doc_id", "left")


def convert_folder(spark, folder: str, recursive: bool = True) -> DataFrame:
    """path, output, md, status, message of a folder's files; files left out have a reason in sources.files.listed()."""
    from ..sources.files import contents
    from ..sources.office import converted

    out = converted(contents(spark, folder, recursive))
    return out.withColumn("output", paths.output_path(F.col("path")))


def write(docs: DataFrame, folder: str, overwrite: bool = True) -> None:
    """Texts as Parquet, one row a document; mode ignore keeps what is there."""
    docs.write.mode("overwrite" if overwrite else "ignore").parquet(folder)
