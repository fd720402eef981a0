"""Documents as HTML: each element a positioned node, by templates on its kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _style() -> Column:
    pt = lambda name, c: F.concat(F.lit(f"{name}:"), T.format_length(c))
    flags = F.concat(F.when(F.array_contains("styles", "bold"), "font-weight:bold;").otherwise(""), F.when(F.array_contains("styles", "italic"), "font-style:italic;").otherwise(""), F.when(F.array_contains("styles", "underline"), "text-decoration:underline;").otherwise(""))
    size = F.when(F.col("font_size").isNotNull(), F.concat(F.lit("font-size:"), T.format_length("font_size"), F.lit(";"))).otherwise("")
    colour = F.when(F.coalesce("rgb", F.lit(0)) != 0, F.concat(F.lit("color:"), T.hex_color("rgb"), F.lit(";"))).otherwise("")
    family = F.when(F.col("font_family").isNotNull(), F.concat(F.lit("font-family:"), T.html_escape("font_family"), F.lit(";"))).otherwise("")
    return F.concat(F.lit("position:absolute;"), pt("left", "left"), F.lit(";"), pt("top", "top"), F.lit(";"), colour, family, size, F.coalesce(flags, F.lit("")))


def node() -> Column:
    """The node of one element."""
    kind, style = F.col("kind"), _style()
    text = T.html_escape(F.coalesce("text", F.lit("")))
    sized = F.concat(style, F.lit("width:"), T.format_length(F.coalesce("width", F.lit(0.0))), F.lit(";height:"), T.format_length(F.coalesce("height", F.lit(0.0))))
    rule = lambda side: F.concat(F.lit('<div style="'), style, F.lit(f"{side}:"), T.format_length(F.coalesce("stretch", F.lit(0.0))), F.lit(';border:1px solid"></div>'))
    return (
        F.when(kind == "text", F.concat(F.lit('<div style="'), style, F.lit('">'), text, F.lit("</div>")))
        .when(kind == "form", F.concat(F.lit('<input style="'), sized, F.lit('" value="'), text, F.lit('"/>')))
        .when(kind == "image", F.concat(F.lit('<img style="'), sized, F.lit('"/>')))
        .when(kind == "hline", rule("width"))
        .when(kind == "vline", rule("height"))
        .when(kind == "page_break", F.lit("<hr/>"))
        .otherwise(F.concat(F.lit("<div>"), text, F.lit("</div>")))
    )


def render(elements: DataFrame) -> DataFrame:
    """(doc_id, html): pages as relatively positioned blocks, elements in order."""
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_idx", F.col("__n").alias("n")))), lambda x: x["n"]), "")
    pages = elements.withColumn("__n", node()).groupBy("doc_id", "page_no").agg(each.alias("body"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "body"))), lambda x: F.concat(F.lit('<div class="page" style="position:relative">'), x["body"], F.lit("</div>"))), "")
    return pages.groupBy("doc_id").agg(F.concat(F.lit("<html><body>"), whole, F.lit("</body></html>")).alias("html"))


def table_html(cells: DataFrame, headers: int = 1) -> DataFrame:
    """(doc_id, table_id, html): rows with header cells and spans."""
    from ..operators import algebra as A

    tag = F.when(F.col("row") < headers, "th").otherwise("td")
    span = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    s = A.spans(cells).withColumn("h", F.concat(F.lit("<"), tag, span("colspan", "col_span"), span("rowspan", "row_span"), F.lit(">"), T.html_escape("text"), F.lit("</"), tag, F.lit(">")))
    rows = s.groupBy("doc_id", "table_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "h"))), lambda x: x["h"]), "").alias("h"))
    return rows.groupBy("doc_id", "table_id").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "h"))), lambda x: F.concat(F.lit("<tr>"), x["h"], F.lit("</tr>"))), ""), F.lit("</table>")).alias("html"))
