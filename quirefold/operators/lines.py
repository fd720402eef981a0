"""Lines, paragraphs and their text, in reading order within a page."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

PAGE = ("doc_id", "page_no")
FACTOR = 1.5


def _order() -> Window:
    return Window.partitionBy(*PAGE).orderBy("elem_idx")


def with_lines(elements: DataFrame) -> DataFrame:
    """Elements with ``line``: 0, 1, .. within a page; a new line begins where an element is off its predecessor's."""
    w = _order()
    off = G.same_line(F.lag("top").over(w), F.lag("height").over(w), "top", "height") != 0
    # the first of a page has no predecessor, which counts as a change
    return elements.withColumn("__new", F.when(F.lag("elem_idx").over(w).isNull() | off, 1).otherwise(0)).withColumn("line", (F.sum("__new").over(w) - 1).cast("int")).drop("__new")


def with_groups(lined: DataFrame, factor: float = FACTOR) -> DataFrame:
    """Lined elements with ``grp``: paragraphs, parted where a line stands more than ``factor`` heights below the one before."""
    w = _order()
    gap = F.col("top") - F.lag("top").over(w) - F.lag("height").over(w)
    new = F.lag("elem_idx").over(w).isNull() | ((F.lag("line").over(w) != F.col("line")) & (gap > factor * F.lag("height").over(w)))
    return lined.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("grp", (F.sum("__new").over(w) - 1).cast("int")).drop("__new")


def page_structure(elements: DataFrame, factor: float = FACTOR) -> DataFrame:
    """Per page: paragraphs, lines, segments and the width and height of what is written."""
    grouped = with_groups(with_lines(elements), factor)
    return grouped.groupBy(*PAGE).agg(
        (F.max("grp") + 1).alias("n_groups"), (F.max("line") + 1).alias("n_lines"), F.count("*").alias("n_segments"),
        (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("text_width"), (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("text_height"),
    )


def joined_text(found: DataFrame, keys: list[str], line: str = "line", order: str = "elem_idx", text: str = "text") -> DataFrame:
    """``keys`` and ``text``: elements of a line parted by tabs, lines by line feeds."""
    row = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"), F.col(text).alias("t"))))
    start = F.struct(F.lit(-1).alias("l"), F.lit("").alias("t"))
    fold = F.aggregate("r", start, lambda a, x: F.struct(x["l"].cast("int").alias("l"), F.concat(a["t"], F.when(a["l"] == -1, "").when(a["l"] == x["l"], "\t").otherwise("\n"), x["t"]).alias("t")), lambda a: a["t"])
    return found.groupBy(*keys).agg(row.alias("r")).select(*keys, fold.alias("text"))


def group_texts(elements: DataFrame, factor: float = FACTOR) -> DataFrame:
    """(doc_id, page_no, grp, text) of every paragraph."""
    return joined_text(with_groups(with_lines(elements), factor), ["doc_id", "page_no", "grp"])


def segmentation_ratio(elements: DataFrame) -> DataFrame:
    """(doc_id, ratio): segments for each line of a document."""
    per_page = with_lines(elements).groupBy(*PAGE).agg(F.count("*").alias("n"), (F.max("line") + 1).alias("lines"))
    return per_page.groupBy("doc_id").agg((F.sum("n") / F.sum("lines")).alias("ratio"))


CANDIDATES = [1.5, 1.25, 1.0, 2.0, 2.5, 3.0, 0.75]


def adaptive_factor(elements: DataFrame, default: float = FACTOR) -> DataFrame:
    """(doc_id, page_no, factor): the gap, in heights, that parts a page's paragraphs best.

    A page of at most five lines keeps the default.  Else smaller factors are tried while there are at most two groups,
    and larger ones when at least half of the lines begin one.  All candidates are counted in one pass.
    """
    w = _order()
    lined = with_lines(elements)
    change = F.lag("line").over(w) != F.col("line")
    gap = F.when(change, (F.col("top") - F.lag("top").over(w) - F.lag("height").over(w)) / F.nullif(F.lag("height").over(w), F.lit(0.0)))
    marked = lined.withColumn("__gap", gap)
    counts = marked.groupBy(*PAGE).agg((F.max("line") + 1).alias("lines"), *[(F.count_if(F.col("__gap") > c) + 1).alias(f"g{k}") for k, c in enumerate(CANDIDATES)])
    many = lambda k: F.col(f"g{k}") * 2 >= F.col("lines")
    good = lambda k: (F.col(f"g{k}") > 2) & ~many(k)
    # upwards: 2.0, 2.5, then out of range at 3.0; downwards: 1.25, 1.0, then 0.75; going down into too many groups steps back by a quarter
    up = F.when(good(3), 2.0).when(good(4), 2.5).otherwise(3.0)
    # one that has too few groups while going up goes on up, as the step is kept
    down = F.when(good(1), 1.25).when(many(1), 1.5).when(good(2), 1.0).when(many(2), 1.25).otherwise(0.75)
    chosen = F.when((F.col("lines") <= 5) | good(0), default).when(many(0), up).otherwise(down)
    return counts.select(*PAGE, chosen.alias("factor"))


def single_column(elements: DataFrame, page_height: float = 792.0) -> DataFrame:
    """(doc_id, page_no, gap, shifted, single): whether a page's middle is set in one column.

    Counted are elements more than 150 points from the page's ends: the widest gap of each line in units of 70 points, at
    most 2, and lines that begin beyond 150 points.  A page without such elements is in one column.
    """
    inner = elements.where((F.col("top") > 150) & (F.col("top") < page_height - 150))
    w = _order()
    same = G.same_line(F.lag("top").over(w), F.lag("height").over(w), "top", "height") == 0
    first = F.lag("elem_idx").over(w).isNull() | ~same
    gap = F.when(~first, F.least((F.col("left") - F.lag("left").over(w) - F.lag("width").over(w)) / 70, F.lit(2.0)))
    marked = inner.select(*PAGE, "elem_idx", "left", first.alias("first"), gap.alias("gap")).withColumn("line", F.sum(F.col("first").cast("int")).over(w))
    lines = marked.groupBy(*PAGE, "line").agg(F.greatest(F.coalesce(F.max("gap"), F.lit(0.0)), F.lit(0.0)).alias("gap"), F.max(F.when(F.col("first") & (F.col("left") > 150), 1).otherwise(0)).alias("shifted"))
    pages = lines.groupBy(*PAGE).agg(F.avg("gap").alias("gap"), F.avg("shifted").alias("shifted"))
    return elements.select(*PAGE).distinct().join(pages, list(PAGE), "left").select(*PAGE, F.coalesce("gap", F.lit(0.0)).alias("gap"), F.coalesce("shifted", F.lit(0.0)).alias("shifted"), (F.coalesce("gap", F.lit(0.0)) < 0.2).__and__(F.coalesce("shifted", F.lit(0.0)) < 0.4).alias("single"))


def _compare(a: tuple, b: tuple) -> int:
    """Above, below or on a line; then by the left edge."""
    (t1, h1, l1, f1), (t2, h2, l2, f2) = a[:4], b[:4]
    b1, b2, least = t1 + h1, t2 + h2, 0.02 if f1 or f2 else 0.0
    shared = b2 - t1 if t2 <= t1 <= b2 else b1 - t2 if t1 <= t2 <= b1 else 0.0
    if shared > least * min(h1, h2):
        return (l1 > l2) - (l1 < l2)
    return -1 if t1 < t2 else 1


def reading_order(elements: DataFrame) -> DataFrame:
    """Elements with ``elem_idx`` anew in reading order; one Arrow group a page, as the order is not transitive.

    Ties keep the order of ``elem_idx``; elements without a top come last.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("elem_idx", kind="stable").reset_index(drop=True)
        tops = page["top"].tolist()
        rows = [(t, 1.0 if h != h or h is None else h, l, k == "form", i) for i, (t, h, l, k) in enumerate(zip(tops, page["height"].tolist(), page["left"].tolist(), page["kind"].tolist(), strict=True))]
        placed, rest = [r for r in rows if r[0] is not None and r[0] == r[0]], [r for r in rows if r[0] is None or r[0] != r[0]]
        order = [r[4] for r in sorted(sorted(placed, key=lambda r: (r[0], r[4])), key=functools.cmp_to_key(_compare)) + rest]
        page = page.iloc[order].reset_index(drop=True)
        page["elem_idx"] = range(len(page))
        return page

    return elements.groupBy(*PAGE).applyInPandas(run, elements.schema)


def between_page_breaks(elements: DataFrame) -> DataFrame:
    """Elements of a merged page with ``break_no``: how many page breaks stand before each."""
    w = Window.partitionBy("doc_id").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, -1)
    return elements.withColumn("break_no", F.coalesce(F.sum((F.col("kind") == "page_break").cast("int")).over(w), F.lit(0)).cast("int"))


def tree_path(*names: Column) -> Column:
    """Path of an element through its parents, as ``Content-0_PositionalContent-3``."""
    return F.concat_ws("_", *names)


def same_line_sql(t1: str, h1: str, t2: str, h2: str) -> str:
    """Whether two elements stand on one line, in DuckDB's SQL."""
    return f"(CASE WHEN {t1} >= {t2} AND {t1} <= {t2} + {h2} THEN {t2} + {h2} - {t1} WHEN {t2} >= {t1} AND {t2} <= {t1} + {h1} THEN {t1} + {h1} - {t2} ELSE 0 END > 0)"


LINED_SQL = f"""
marked AS (
  SELECT *, lag(top) OVER w AS t0, lag(height) OVER w AS h0, lag(elem_idx) OVER w AS e0 FROM elements WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY elem_idx)),
lined AS (
  SELECT *, sum(CASE WHEN e0 IS NULL OR NOT {same_line_sql("t0", "h0", "top", "height")} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY elem_idx) - 1 AS line FROM marked),
stepped AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, page_no ORDER BY elem_idx) AS l0 FROM lined),
grouped AS (
  SELECT *, sum(CASE WHEN e0 IS NULL OR (l0 <> line AND top - t0 - h0 > {FACTOR} * h0) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY elem_idx) - 1 AS grp FROM stepped)"""
