"""Visual JSON: pages of groups of lines of segments, and tables, as nested structs and JSON strings with sorted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import algebra as A
from ..operators import lines as L


def segment(columns: list[str] | None = None) -> Column:
    """The record of one segment; keys in order of the alphabet.

    With the columns of a layout it holds borders, neighbours (the segment in each shadow), the visual span and the letter
    spacing too.
    """
    have, f2, sides = set(columns or ()), T.floor2, (("b", "bottom", "below"), ("l", "left", "left"), ("r", "right", "right"), ("t", "top", "above"))
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.col(c).cast("string"), F.lit("_0")))
    box = F.struct(f2(F.col("top") + F.col("height")).alias("b"), f2("left").alias("l"), f2(F.col("left") + F.col("width")).alias("r"), f2("top").alias("t"))
    fields = []
    if {f"border_{s}" for _, s, _ in sides} <= have:
        fields.append(F.struct(*[F.coalesce(f"border_{s}", F.lit(False)).alias(k) for k, s, _ in sides]).alias("border"))
    fields += [box.alias("box"), T.hex_color(F.coalesce("rgb", F.lit(0))).alias("color"), F.col("font_family").alias("fontFamily"), F.col("font_size").alias("fontSize"), F.concat(F.col("elem_idx").cast("string"), F.lit("_0")).alias("id")]
    if "letter_spacing" in have:
        fields.append(F.col("letter_spacing").alias("letterSpacing"))
    if {f"shadow_{s}" for _, _, s in sides} <= have:
        fields.append(F.struct(*[name(f"shadow_{s}").alias(k) for k, _, s in sides]).alias("neighbour"))
    if {f"vis_{s}" for _, s, _ in sides} <= have:
        fields.append(F.struct(*[f2(f"vis_{s}").alias(k) for k, s, _ in sides]).alias("span"))
    fields += [F.array_sort(F.coalesce("styles", F.array().cast("array<string>"))).alias("styles"), F.col("text").alias("text")]
    return F.struct(*fields)


def group_name(partition: Column | str) -> Column:
    """Which list of a page a group belongs to."""
    p = F.col(partition) if isinstance(partition, str) else partition
    return F.when(p == "HEADER", "headerGroups").when(p == "FOOTER", "footerGroups").otherwise("groups")


def pages(elements: DataFrame, factor: float = L.FACTOR) -> DataFrame:
    """(doc_id, page_no, groups, headerGroups, footerGroups): groups of lines of segments in order of appearance.

    ``partition``, where present, tells headers and footers.  Three aggregations on nested keys share one partitioning.
    """
    e = elements if "partition" in elements.columns else elements.withColumn("partition", F.lit("CONTENT"))
    # paragraphs that the layout found (vg_id) come before those by gaps, in order of their first segment
    lined = L.with_lines(e)
    g = L.with_groups(lined, factor) if "vg_id" not in e.columns else lined.withColumn("grp", F.coalesce("vg_id", F.lit(-1) - F.col("elem_idx")))
    g = g.withColumn("__s", segment(e.columns))
    ordered = lambda order, value: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])
    lines = g.groupBy("doc_id", "page_no", "grp", "line").agg(F.first("partition").alias("partition"), F.min("elem_idx").alias("at"), ordered("elem_idx", "__s").alias("__s")).withColumn("__l", F.struct(F.col("__s").alias("segments")))
    groups = lines.groupBy("doc_id", "page_no", "grp").agg(F.min_by("partition", "at").alias("partition"), ordered("at", "__l").alias("__l"), F.min("at").alias("at")).withColumn("__g", F.struct(F.col("__l").alias("lines")))
    of = lambda name: F.transform(F.array_sort(F.collect_list(F.when(group_name("partition") == name, F.struct(F.col("at").alias("o"), F.col("__g").alias("v"))))), lambda x: x["v"]).alias(name)
    return groups.groupBy("doc_id", "page_no").agg(of("footerGroups"), of("groups"), of("headerGroups"))


def phrases(elements: DataFrame, factor: float = L.FACTOR, pretty: bool = False) -> DataFrame:
    """(doc_id, json): the document's pages as one JSON object."""
    p = pages(elements, factor).withColumn("__p", F.struct("footerGroups", "groups", "headerGroups", F.col("page_no").alias("page")))
    docs = p.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "__p"))), lambda x: x["__p"]).alias("pages"))
    return docs.select("doc_id", F.to_json(F.struct("pages"), {"pretty": str(pretty).lower()}).alias("json"))


def tables(cells: DataFrame, headers: int = 1, caption: DataFrame | None = None, pretty: bool = False) -> DataFrame:
    """(doc_id, table_id, json): metadata, columns and cells with their spans."""
    ordered = lambda keys, value: F.transform(F.array_sort(F.collect_list(F.struct(*keys, F.col(value).alias("v")))), lambda x: x["v"])
    s = A.spans(cells).withColumn("__c", F.struct(F.struct("col", "row").alias("position"), F.struct(F.col("col_span").alias("columns"), F.col("row_span").alias("rows")).alias("span"), "text"))
    rows = s.groupBy("doc_id", "table_id", "row").agg(ordered(["col"], "__c").alias("__c")).withColumn("__r", F.struct(F.col("__c").alias("cells")))
    data = rows.groupBy("doc_id", "table_id").agg(ordered(["row"], "__r").alias("data"))
    titles = A.column_titles(cells, headers).withColumn("__t", F.struct(F.col("col").alias("index"), "path", "title"))
    cols = titles.groupBy("doc_id", "table_id").agg(ordered(["col"], "__t").alias("columns"))
    meta = A.metadata(cells, headers, caption)
    m = meta.select("doc_id", "table_id", F.struct(F.col("header_count").alias("columnHeaderCount"), F.col("columns").alias("columns"), F.col("currency_name").alias("currencyName"), F.col("currency_symbol").alias("currencySymbol"), F.col("factor").alias("multiplicativeFactor"), "rows").alias("metadata"))
    return m.join(cols, ["doc_id", "table_id"]).join(data, ["doc_id", "table_id"]).select("doc_id", "table_id", F.to_json(F.struct("columns", "data", F.col("table_id").alias("id"), "metadata"), {"pretty": str(pretty).lower()}).alias("json"))


def combined(elements: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, json): ``phrases`` and ``tables`` of a document in one object, tables in order."""
    t = tables(cells).groupBy("doc_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("table_id", "json"))), lambda x: x["json"])).alias("t"))
    p = phrases(elements).withColumnRenamed("json", "p")
    return p.join(t, "doc_id", "left").select("doc_id", F.concat(F.lit('{"phrases":'), "p", F.lit(',"tables":['), F.coalesce("t", F.lit("")), F.lit("]}")).alias("json"))
