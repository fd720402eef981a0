"""A facade: one table of elements and what can be asked of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import layout, lines, pages, partition
from .options import Options
from .sinks import html, visual_json
from .sources import html as html_source
from .sources import text_layout


@dataclass(frozen=True)
class DocumentFrame:
    """Elements of many documents; every method gives a DataFrame and runs nothing."""

    elements: DataFrame
    options: Options = Options()

    @staticmethod
    def from_texts(documents: DataFrame, options: Options | None = None) -> DocumentFrame:
        return DocumentFrame(text_layout.text_elements(documents), options or Options())

    @staticmethod
    def from_html(pages_: DataFrame, options: Options | None = None) -> DocumentFrame:
        return DocumentFrame.from_texts(html_source.documents(pages_), options)

    def lines(self) -> DataFrame:
        return lines.with_lines(self.elements)

    def paragraphs(self) -> DataFrame:
        return lines.group_texts(self.elements)

    def partitions(self) -> DataFrame:
        return partition.partitions(self.elements, options=self.options)

    def layout(self) -> DataFrame:
        return layout.document_layout(self.elements, self.options)

    def tables(self) -> DataFrame:
        return layout.cells_of(self.elements, self.layout())

    def merged(self) -> DocumentFrame:
        return DocumentFrame(pages.merge_pages(self.elements, text_layout.pages_of(self.elements))[0], self.options)

    def to_visual_json(self) -> DataFrame:
        return visual_json.phrases(self.elements)

    def to_html(self) -> DataFrame:
        return html.render(self.elements)

    def create_views(self, prefix: str = "") -> None:
        """Temporary views ``elements``, ``lines`` and ``paragraphs`` for SQL."""
        for name, df in (("elements", self.elements), ("lines", self.lines()), ("paragraphs", self.paragraphs())):
            df.createOrReplaceTempView(f"{prefix}{name}")


def read_texts(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(doc_id, source, text) of the ``.txt`` and ``.html`` files under a path; other kinds give a null text and an error code."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    text, kind = F.decode("content", "UTF-8"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    read = F.when(kind == "txt", text).when(kind.isin("html", "htm"), html_source.block_text(text))
    return files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source"), read.alias("text"), F.when(read.isNull(), F.concat(F.lit("no reader for "), kind)).alias("error_code"))
