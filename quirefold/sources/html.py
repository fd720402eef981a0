"""HTML as text: scripts, styles and tags out, blocks on lines of their own, entities resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "p|div|br|li|tr|h[1-6]|ul|ol|table|section|article|header|footer|title|body|html|head|nav|main|pre|blockquote"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def block_text(html: Column | str) -> Column:
    """Text of a page, a block a line; null stays null."""
    c = F.col(html) if isinstance(html, str) else html
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->", "")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t\r\n]+", " "), rf"(?i) ?</?({BLOCK})\b[^>]*> ?", "\n")
    c = F.regexp_replace(c, "<[^>]*>", "")
    for a, b in ENTITIES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(c, "\n+", "\n"), "^\n|\n$", "")


def documents(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of pages (page_id, html)."""
    return pages.select(F.col("page_id").alias("doc_id"), block_text("html").alias("text"))


def text_sql(column: str) -> str:
    """``block_text`` in DuckDB's SQL."""
    c = f"regexp_replace({column}, '(?is)<(script|style)\\b.*?</(script|style)\\s*>|<!--.*?-->', '', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '[ \\t\\r\\n]+', ' ', 'g'), '(?i) ?</?({BLOCK})\\b[^>]*> ?', chr(10), 'g')"
    c = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    for a, b in ENTITIES.items():
        c = f"replace({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace(regexp_replace({c}, '\\n+', chr(10), 'g'), '^\\n|\\n$', '', 'g')"
