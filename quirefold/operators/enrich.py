"""Improving detected tables: header votes, captions, splitting, parted header cells.  Relational; keys as in ``algebra``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .algebra import TABLE

#: A row this far from the one above, in the share of cells of another kind, may begin a table of its own.
SPLIT_JUMP = 0.6


def header_votes(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, headers): rows that most columns take for header.

    A column votes for the last row before its first number or date, styled rows (``highlighted``) first where there are
    any.  The row with most votes wins, the upper of equals; where it has no more than half of the votes, or the votes are
    for no row, the header ends before the row after the first that is filled.
    """
    c = cells if "highlighted" in cells.columns else cells.withColumn("highlighted", F.lit(False))
    full = F.col("text") != ""
    per = c.groupBy(*TABLE, "col").agg(
        F.max(F.when(full & F.col("highlighted"), F.col("row"))).alias("styled"), F.min(F.when(full & (T.type_priority("text") < 3), F.col("row"))).alias("body"),
        F.min(F.when(full, F.col("row"))).alias("first"), F.max(F.when(full & (T.type_priority("text") >= 3), F.col("row"))).alias("words"),
    )
    vote = F.coalesce("styled", F.when(F.col("body") > 0, F.col("body") - 1), F.when(F.col("body").isNull(), F.lit(0)), F.lit(-1))
    votes = per.withColumn("vote", vote).groupBy(*TABLE, "vote").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    w = Window.partitionBy(*TABLE)
    ranked = votes.withColumns({"all": F.sum("n").over(w), "filled": F.min("first").over(w), "k": F.row_number().over(w.orderBy(F.desc("n"), "vote"))}).where("k = 1")
    won = (F.col("n") * 2 > F.col("all")) & (F.col("vote") >= 0)
    return ranked.select(*TABLE, F.when(won, F.col("vote") + 1).otherwise(F.coalesce("filled", F.lit(0))).cast("int").alias("headers"))


def captions(elements: DataFrame, placed: DataFrame, gap: float = 3.0) -> DataFrame:
    """(doc_id, table_id, caption): the texts of the nearest line above a table that overlaps it and stands at most ``gap`` heights off.

    ``placed`` gives the elements of tables (doc_id, table_id, elem_idx).
    """
    e = elements.select("doc_id", "page_no", "elem_idx", "top", "left", "width", "height", "text").where("text IS NOT NULL")
    mine = e.join(placed.select("doc_id", "table_id", "elem_idx"), ["doc_id", "elem_idx"])
    box = mine.groupBy("doc_id", "table_id").agg(F.min_by("page_no", "top").alias("page_no"), F.min("top").alias("t"), F.min("left").alias("l"), F.max(F.col("left") + F.col("width")).alias("r"))
    free = e.join(placed.select("doc_id", "elem_idx"), ["doc_id", "elem_idx"], "left_anti")
    bottom = F.col("top") + F.col("height")
    near = free.join(box, ["doc_id", "page_no"]).where((bottom <= F.col("t")) & (F.col("t") - bottom <= gap * F.col("height")) & (F.least(F.col("left") + F.col("width"), F.col("r")) > F.greatest("left", "l")))
    nearest = near.withColumn("m", F.max(bottom).over(Window.partitionBy(*TABLE))).where(F.col("top") < F.col("m")).where(F.col("top") + F.col("height") > F.col("m") - F.col("height") / 2)
    return nearest.groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), "\t").alias("caption"))


def split_tables(cells: DataFrame, jump: float = SPLIT_JUMP) -> DataFrame:
    """Cells with ``part`` and rows counted anew within it: a part begins at a row of words alone that follows numbers.

    Such a row, the third or later, has no number, at least two filled cells, and at least ``jump`` of those under numbers
    or dates.
    """
    w = Window.partitionBy(*TABLE, "col").orderBy("row")
    kinds = cells.where("text <> ''").withColumn("rank", T.type_priority("text"))
    kinds = kinds.withColumn("above", F.lag("rank").over(w))
    rows = kinds.groupBy(*TABLE, "row").agg(F.count("*").alias("n"), F.min("rank").alias("least"), F.count_if(F.col("above").between(1, 2)).alias("under"))
    start = rows.where((F.col("row") >= 2) & (F.col("least") >= 3) & (F.col("n") >= 2) & (F.col("under") >= jump * F.col("n"))).select(*TABLE, "row", F.lit(1).alias("start"))
    lined = cells.join(start, [*TABLE, "row"], "left").withColumn("part", F.coalesce(F.sum("start").over(Window.partitionBy(*TABLE, "col").orderBy("row")), F.lit(0)).cast("int"))
    return lined.drop("start").withColumn("row", (F.col("row") - F.min("row").over(Window.partitionBy(*TABLE, "part"))).cast("int"))


def parted_header_cells(elements: DataFrame, headers: int = 1) -> DataFrame:
    """(doc_id, table_id, col, elem_idx): header elements after the first of their cell that do not go on what is before them, so need a column."""
    e = elements if "table_id" in elements.columns else elements.withColumn("table_id", F.lit(0))
    w = Window.partitionBy(*TABLE, "row", "col").orderBy("left", "elem_idx")
    return e.where(F.col("row") < headers).withColumn("before", F.lag("text").over(w)).where(F.col("before").isNotNull() & ~T.can_be_connected("before")).select(*TABLE, "col", "elem_idx")


def part_header_cells(elements: DataFrame, headers: int = 1) -> DataFrame:
    """Elements with ``col`` anew: parted header cells get columns of their own, and what stands below goes to the header it overlaps most."""
    e = elements if "table_id" in elements.columns else elements.withColumn("table_id", F.lit(0))
    is_head, is_body = F.col("row") < headers, F.col("row") >= headers
    w = Window.partitionBy(*TABLE, "row").orderBy("left", "elem_idx")
    beside = e.withColumns({"__beside": F.lag("col").over(w), "__before": F.lag("text").over(w)})
    # of one column, the element before in the row is the one before in the cell
    cut = (F.col("__beside") == F.col("col")) & F.col("__before").isNotNull() & ~T.can_be_connected("__before")
    new = cut | F.col("__beside").isNull() | (F.col("__beside") != F.col("col"))
    placed = beside.withColumn("__col", F.when(is_head, F.sum(new.cast("int")).over(w) - 1).cast("int"))
    # each header column's span, then all of a table's, handed down to what stands below: windows over the table's own rows, no join
    column = Window.partitionBy(*TABLE, "__col")
    spanned = placed.withColumns({"__lo": F.min("left").over(column), "__hi": F.max(F.col("left") + F.col("width")).over(column)})
    spans = spanned.withColumn("__spans", F.collect_set(F.when(F.col("__col").isNotNull(), F.struct("__col", "__lo", "__hi"))).over(Window.partitionBy(*TABLE)))
    overlap = lambda x: F.least(F.col("left") + F.col("width"), x["__hi"]) - F.greatest("left", x["__lo"])
    best = -F.array_max(F.transform("__spans", lambda x: F.struct(overlap(x).alias("o"), (-x["__col"]).alias("k"))))["k"]
    return spans.withColumn("col", F.coalesce(F.when(is_body, best).otherwise(F.col("__col")), "col")).select(*e.columns)
