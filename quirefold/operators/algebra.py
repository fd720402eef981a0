"""Table algebra on cells (doc_id, table_id, row, col, text): a relation in, a relation out.

Every window and group has (doc_id, table_id) in its key, so one shuffle serves a chain of these.  Columns ``v_merged`` and
``h_merged``, where absent, are false; an empty text is an empty cell.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import geometry as G
from ..functions import text as T

TABLE = ["doc_id", "table_id"]


def _flags(cells: DataFrame) -> DataFrame:
    for c in ("v_merged", "h_merged"):
        if c not in cells.columns:
            cells = cells.withColumn(c, F.lit(False))
    return cells


def region(cells: DataFrame, r1: int, r2: int, c1: int, c2: int) -> DataFrame:
    """Cells of rows r1 .. r2 and columns c1 .. c2, ends included."""
    return cells.where(F.col("row").between(r1, r2) & F.col("col").between(c1, c2))


def mark_merged(cells: DataFrame, down: Column | str, across: Column | str = "false") -> DataFrame:
    """Cells with merge flags from two conditions, never in the first row or column."""
    d, a = (F.expr(x) if isinstance(x, str) else x for x in (down, across))
    return cells.withColumn("v_merged", d & (F.col("row") > 0)).withColumn("h_merged", a & (F.col("col") > 0))


def resolve_merged(cells: DataFrame) -> DataFrame:
    """Cells with ``merged_text``: that of the cell up the column where vertically merged, then left along the row.

    The walk left reads, for each cell of that row, its own text; so a cell merged down and then left takes the text of
    the first cell of the row in which its column's walk ended.
    """
    c = _flags(cells)
    along, down = Window.partitionBy(*TABLE, "row").orderBy("col"), Window.partitionBy(*TABLE, "col").orderBy("row")
    # what each cell finds along its own row; the cell that heads a column's merge hands it down
    head = F.last(F.when(~F.col("h_merged") | (F.col("col") == 0), F.struct("col", "text")), ignorenulls=True).over(along)
    c = c.withColumn("__along", head).withColumn("__down", F.last(F.when(~F.col("v_merged") | (F.col("row") == 0), F.struct("row", "__along")), ignorenulls=True).over(down))
    found = c.withColumns({"at_row": F.col("__down.row"), "at_col": F.col("__down.__along.col"), "merged_text": F.col("__down.__along.text")}).where("at_row IS NOT NULL AND at_col IS NOT NULL")
    return found.drop("__along", "__down")


def transpose(cells: DataFrame) -> DataFrame:
    """Rows as columns and columns as rows, merge flags too."""
    c = _flags(cells)
    return c.select(*TABLE, F.col("col").alias("row"), F.col("row").alias("col"), "text", F.col("h_merged").alias("v_merged"), F.col("v_merged").alias("h_merged"))


def curtail(cells: DataFrame, rows: int | Column) -> DataFrame:
    """The first ``rows`` rows."""
    return cells.where(F.col("row") < rows)


def delete_rows(cells: DataFrame, gone: Column) -> DataFrame:
    """Cells without the rows for which ``gone`` holds in any cell; rows are numbered anew.

    A cell that is merged into a deleted row's takes over its text and heads the rest of the merge.
    """
    c = _flags(cells)
    per_row = Window.partitionBy(*TABLE, "row")
    down = Window.partitionBy(*TABLE, "col").orderBy("row")
    c = c.withColumn("__gone", F.max(gone.cast("int")).over(per_row) == 1)
    # the nearest head of the run of merged cells above, and whether a kept cell stands between
    head = F.last(F.when(~F.col("v_merged"), F.struct("text", "row")), ignorenulls=True).over(down)
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("__head", head).withColumn("__kept", F.max(F.when(~F.col("__gone"), F.col("row"))).over(before))
    heads = F.col("v_merged") & (F.coalesce(F.col("__kept"), F.lit(-1)) < F.col("__head.row"))
    kept = c.where("NOT __gone").withColumn("text", F.when(heads, F.col("__head.text")).otherwise(F.col("text"))).withColumn("v_merged", F.col("v_merged") & ~heads)
    return kept.withColumn("row", (F.dense_rank().over(Window.partitionBy(*TABLE).orderBy("row")) - 1).cast("int")).drop("__gone", "__head", "__kept")


def merge_rows(cells: DataFrame, first: int, last: int) -> DataFrame:
    """Rows ``first`` .. ``last`` as one: texts of a column joined by line feeds, equal ones once; later rows move up."""
    target = F.when(F.col("row").between(first, last), first).when(F.col("row") > last, F.col("row") - (last - first)).otherwise(F.col("row")).cast("int")
    rows = F.array_sort(F.collect_list(F.struct(F.col("__r"), "text")))
    joined = F.array_join(F.array_distinct(F.filter(F.transform(rows, lambda x: x["text"]), lambda t: t != "")), "\n")
    return cells.withColumn("__r", F.col("row")).withColumn("row", target).groupBy(*TABLE, "row", "col").agg(joined.alias("text"))


def shape(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, n_rows, n_cols, n_filled)."""
    return cells.groupBy(*TABLE).agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count_if(F.col("text") != "").alias("n_filled"))


def column_boundaries(elements: DataFrame, headers: int = 1) -> DataFrame:
    """(doc_id, table_id, col, lo, hi) from the header's cells; from all cells where the header is empty in a column."""
    e = elements if "table_id" in elements.columns else elements.withColumn("table_id", F.lit(0))
    right, head = F.col("left") + F.col("width"), F.col("row") < headers
    return e.groupBy(*TABLE, "col").agg(F.coalesce(F.min(F.when(head, F.col("left"))), F.min("left")).alias("lo"), F.coalesce(F.max(F.when(head, right)), F.max(right)).alias("hi"))


def row_symmetry(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, symmetry): 1 less the mean deviation of filled cells a row, relative to their mean."""
    rows = cells.groupBy(*TABLE, "row").agg(F.count_if(F.col("text") != "").alias("n"))
    both = rows.withColumn("m", F.avg("n").over(Window.partitionBy(*TABLE)))
    return both.groupBy(*TABLE).agg((1 - F.sum(F.abs(F.col("n") - F.col("m"))) / F.nullif(F.count("*") * F.max("m"), F.lit(0.0))).alias("symmetry"))


def row_based(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, n_used, row_based): whether at most two columns hold anything."""
    used = F.count_distinct(F.when(F.col("text") != "", F.col("col")))
    return cells.groupBy(*TABLE).agg(used.alias("n_used"), (used <= 2).alias("row_based"))


def cell_borders(elements: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, col, border_*): a cell has the borders that any of its elements has."""
    e = elements if "table_id" in elements.columns else elements.withColumn("table_id", F.lit(0))
    return e.groupBy(*TABLE, "row", "col").agg(*[F.bool_or(f"border_{s}").alias(f"border_{s}") for s in ("top", "bottom", "left", "right")])


def lines_significant(borders: DataFrame) -> DataFrame:
    """(doc_id, table_id, share, significant): whether six tenths of the rows have a border below in some cell."""
    rows = borders.groupBy(*TABLE, "row").agg(F.bool_or(F.col("border_bottom") | F.col("border_top")).alias("b"))
    share = F.count_if("b") / F.count("*")
    return rows.groupBy(*TABLE).agg(share.alias("share"), (share >= 0.6).alias("significant"))


def grid_consistency(borders: DataFrame) -> DataFrame:
    """(doc_id, table_id, rows_ok, cols_ok): rows agree within themselves on top and bottom borders, columns on those at their sides."""
    same = lambda *c: (F.count_distinct(*c) <= 1)
    rows = borders.groupBy(*TABLE, "row").agg(same("border_top", "border_bottom").alias("ok")).groupBy(*TABLE).agg(F.bool_and("ok").alias("rows_ok"))
    cols = borders.groupBy(*TABLE, "col").agg(same("border_left", "border_right").alias("ok")).groupBy(*TABLE).agg(F.bool_and("ok").alias("cols_ok"))
    return rows.join(cols, TABLE)


def spans(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, col, text, row_span, col_span) of the cells that head a merge or stand alone."""
    c = _flags(cells)
    down, along = Window.partitionBy(*TABLE, "col").orderBy("row"), Window.partitionBy(*TABLE, "row").orderBy("col")
    c = c.withColumn("__v", F.sum((~F.col("v_merged")).cast("int")).over(down)).withColumn("__h", F.sum((~F.col("h_merged")).cast("int")).over(along))
    c = c.withColumn("row_span", F.count("*").over(Window.partitionBy(*TABLE, "col", "__v")).cast("int")).withColumn("col_span", F.count("*").over(Window.partitionBy(*TABLE, "row", "__h")).cast("int"))
    return c.where("NOT v_merged AND NOT h_merged").select(*TABLE, "row", "col", "text", "row_span", "col_span")


def hierarchy(firsts: DataFrame, headers: int = 1) -> DataFrame:
    """(doc_id, table_id, row, level, parent, path) from the left edge and text of each row's first cell.

    Rows up to and including the first after the header have level 0.  Afterwards an edge more than half a point right of
    the last open one opens a level; one as far left closes levels down to the first that it reaches.  A row without a
    first cell keeps the level.  One Arrow group a table, which is held whole and passed once.
    """

    def levels(rows: list[int], lefts: list[float | None]) -> list[int]:
        level, stack, out = 0, [], []
        for row, left in zip(rows, lefts, strict=True):
            if row > headers and left is not None:
                stack = stack or [left]
                if left - stack[-1] > 0.5:
                    stack.append(left)
                    level += 1
                elif stack[-1] - left > 0.5:
                    open_ = [s for s in stack if s - left <= 0.5]
                    level, stack = max(level - (len(stack) - len(open_)), 0), open_ or [left]
            out.append(0 if row <= headers else level)
        return out

    return _folded(firsts.select(*TABLE, "row", F.col("left").cast("double").alias("left"), "text"), ["row", "left", "text"], lambda t: levels(t.column("row").to_pylist(), t.column("left").to_pylist()))


def _folded(rows: DataFrame, order: list[str], levels: Callable[[pa.Table], list[int]]) -> DataFrame:
    """(doc_id, table_id, row, text, level, parent, path) of each table's rows in order, in one pass: the open rows are kept as a stack."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([*[StructField(c, kinds[c]) for c in (*TABLE, "row", "text")], StructField("level", IntegerType()), StructField("parent", kinds["row"]), StructField("path", StringType())])

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in order], null_placement="at_start"))
        found, stack, parents, paths = levels(table), [], [], []
        for row, text, level in zip(table.column("row").to_pylist(), table.column("text").to_pylist(), found, strict=True):
            while stack and stack[-1][0] >= level:
                stack.pop()
            parents.append(stack[-1][1] if stack else None)
            paths.append("/".join([*[t for _, _, t in stack if t is not None], *([text] if text is not None else [])]))
            stack.append((level, row, text))
        out = table.select([*TABLE, "row", "text"]).append_column("level", pa.array(found, pa.int32()))
        return out.append_column("parent", pa.array(parents, table.schema.field("row").type)).append_column("path", pa.array(paths, pa.string()))

    return rows.groupBy(*TABLE).applyInArrow(run, schema)


def with_parents(levels: DataFrame) -> DataFrame:
    """Rows with ``parent``, the nearest earlier row of a lower level (null if none), and ``path``, the texts from the top."""
    return _folded(levels.select(*TABLE, "row", "text", "level"), ["row"], lambda t: t.column("level").to_pylist())


def header_depth(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, headers): rows until half of the columns have held something."""
    first = cells.groupBy(*TABLE, "col").agg(F.min(F.when(F.col("text") != "", F.col("row"))).alias("first"))
    w = Window.partitionBy(*TABLE)
    reached = first.withColumn("cols", F.count("*").over(w)).withColumn("have", F.count("first").over(w.orderBy(F.col("first").asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)))
    return reached.groupBy(*TABLE).agg(F.coalesce(F.min(F.when((F.col("have") * 2 >= F.col("cols")) & F.col("first").isNotNull(), F.col("first"))) + 1, F.lit(0)).alias("headers"))


def header_counts() -> list[Column]:
    """What a row of cells with ``highlighted`` and ``coloured`` is judged by as a header."""
    full = F.col("text") != ""
    return [F.count("*").alias("cols"), F.count_if(full).alias("n"), F.count_if(full & (T.regex_type("text") == T.NUMERIC)).alias("num"), F.count_if(full & F.col("highlighted")).alias("h"), F.count_if(full & F.col("coloured")).alias("c")]


def header_score(rows: Callable[[str], Column] = F.col) -> Column:
    """Confidence that a row is one of a header, from its ``header_counts``."""
    d = F.nullif(rows("n"), F.lit(0))
    num, h, c = rows("num") / d, rows("h") / d, rows("c") / d
    return F.when(F.coalesce(num, F.lit(1.0)) > 0.15, 0.0).otherwise(4 * F.abs(h - 0.5) * F.abs(c - 0.5) * (h + 0.1) * (rows("n") / rows("cols")) * (1 + F.ln(rows("n").cast("double"))) * (1 - num))


def header_confidence(cells: DataFrame, headers: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(doc_id, table_id, headers, confidence): the mean confidence of the header rows before the first weak one.

    A row is weak where more than 15 % of its cells are numbers, and strong where its cells agree on bold or italic type
    and on colour, and many are filled.  Cells may have ``highlighted`` and ``coloured``; absent, they are false.
    """
    for c in ("highlighted", "coloured"):
        if c not in cells.columns:
            cells = cells.withColumn(c, F.lit(False))
    rows = cells.join(headers, TABLE).where(F.col("row") < F.col("headers")).groupBy(*TABLE, "row").agg(*header_counts())
    w = Window.partitionBy(*TABLE).orderBy("row")
    strong = rows.withColumn("score", header_score()).withColumn("weak", F.sum((F.col("score") <= threshold).cast("int")).over(w)).where("weak = 0")
    kept = strong.groupBy(*TABLE).agg(F.count("*").cast("int").alias("headers"), F.avg("score").alias("confidence"))
    return headers.select(*TABLE).join(kept, TABLE, "left").select(*TABLE, F.coalesce("headers", F.lit(0)).alias("headers"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def numeric_columns(cells: DataFrame, headers: int = 1) -> DataFrame:
    """(doc_id, table_id, col): columns after the first whose cells, in rows that hold a number beyond the first column, are amounts or empty."""
    body = cells.where(F.col("row") >= headers)
    w = Window.partitionBy(*TABLE, "row")
    rows = body.withColumn("num", F.max(((F.col("col") > 0) & (T.regex_type("text") == T.NUMERIC)).cast("int")).over(w)).where("num = 1")
    return rows.where("col > 0").groupBy(*TABLE, "col").agg(F.bool_and((F.col("text") == "") | T.is_amount_representation("text")).alias("ok")).where("ok").select(*TABLE, "col")


def total_rows(cells: DataFrame, headers: int = 1, longest: int = 3) -> DataFrame:
    """(doc_id, table_id, row): rows that say total and have an amount right of it; runs of more than ``longest`` do not count."""
    w = Window.partitionBy(*TABLE, "row").orderBy("col")
    full = cells.where((F.col("row") >= headers) & (F.col("text") != ""))
    hit = full.withColumn("next", F.lead("text").over(w)).where(T.means_total("text") & T.is_amount_representation("next")).select(*TABLE, "row").distinct()
    return drop_long_runs(hit, longest)


def drop_long_runs(rows: DataFrame, longest: int = 3) -> DataFrame:
    """Rows without the runs of consecutive ones that are longer than ``longest``."""
    island = F.col("row") - F.row_number().over(Window.partitionBy(*TABLE).orderBy("row"))
    return rows.withColumn("g", island).withColumn("n", F.count("*").over(Window.partitionBy(*TABLE, "g"))).where(F.col("n") <= longest).select(*TABLE, "row")


def split_votes(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, changed, jump): per row, cells that are of another kind than the one above, and its share of words turned numbers or back."""
    w = Window.partitionBy(*TABLE, "col").orderBy("row")
    kinds = cells.where(F.col("text") != "").withColumn("kind", T.regex_type("text")).withColumn("above", F.lag("kind").over(w))
    rows = kinds.groupBy(*TABLE, "row").agg(F.count_if(F.col("above").isNotNull() & (F.col("above") != F.col("kind"))).alias("changed"), F.count("above").alias("n"))
    return rows.select(*TABLE, "row", "changed", F.coalesce(F.try_divide(F.col("changed"), F.col("n")), F.lit(0.0)).alias("jump"))


def semantic_jump(prev: Column, cur: Column) -> Column:
    """How far two rows, arrays of texts, differ in digits: the change of the share of texts with digits."""
    share = lambda a: F.coalesce(F.try_divide(F.size(F.filter(a, T.has_numeric_content)), F.size(a)), F.lit(0.0))
    return F.abs(share(prev) - share(cur))


def continued_tables(tables: DataFrame, between: DataFrame | None = None) -> DataFrame:
    """(doc_id, table_id, root): chains of tables of which each continues the one before, to the first.

    ``tables`` has n_cols, the header texts as one string, and first_idx and last_idx of the elements; a table continues its
    predecessor when the columns and headers are the same and no element of ``between`` (doc_id, elem_idx) stands between.
    """
    w = Window.partitionBy("doc_id").orderBy("first_idx")
    t = tables.withColumns({"p_cols": F.lag("n_cols").over(w), "p_head": F.lag("header").over(w), "p_last": F.lag("last_idx").over(w)})
    same = F.coalesce((F.col("p_cols") == F.col("n_cols")) & (F.col("p_head") == F.col("header")), F.lit(False))
    t = t.withColumn("same", same)
    if between is not None:
        e = between.select("doc_id", F.col("elem_idx").alias("__e"))
        parted = t.where("same").join(e, "doc_id").where((F.col("__e") > F.col("p_last")) & (F.col("__e") < F.col("first_idx"))).select("doc_id", "table_id", F.lit(True).alias("parted")).distinct()
        t = t.join(parted, TABLE, "left").withColumn("same", F.col("same") & F.col("parted").isNull())
    t = t.withColumn("chain", F.sum((~F.col("same")).cast("int")).over(w))
    return t.withColumn("root", F.first("table_id").over(Window.partitionBy("doc_id", "chain").orderBy("first_idx"))).select(*TABLE, "root")


def merge_continued(cells: DataFrame, chains: DataFrame, headers: int = 1) -> DataFrame:
    """Cells of each chain as one table, the headers of its later parts left out, rows numbered on."""
    both = cells.join(chains, TABLE).where((F.col("table_id") == F.col("root")) | (F.col("row") >= headers))
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "root").orderBy("table_id", "row")) - 1
    return both.withColumn("row", rank.cast("int")).withColumn("table_id", F.col("root")).drop("root")


def internal_columns(elements: DataFrame, narrow: float = 10.8) -> DataFrame:
    """(doc_id, table_id, col): columns that belong to the one before: narrow everywhere, headless, and never filled in a row beside it but for a sign of currency."""
    e = elements if "table_id" in elements.columns else elements.withColumn("table_id", F.lit(0))
    mine = e.groupBy(*TABLE, "col").agg(F.max("width").alias("w"), F.min("row").alias("first"), F.collect_set(F.when(~T.is_semantically_incomplete("text"), F.col("row"))).alias("rows"))
    prev = mine.select(*TABLE, (F.col("col") + 1).alias("col"), F.col("rows").alias("p_rows"))
    return mine.join(prev, [*TABLE, "col"]).where((F.col("w") <= narrow) & (F.col("first") > 0) & (F.size(F.array_intersect("rows", "p_rows")) == 0)).select(*TABLE, "col")


def wrapped_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, into): rows that go on what the row above says: fewer cells, all under filled ones, none a number, and text above unfinished.

    ``into`` is the first row of the run, so a paragraph in cells becomes one row.
    """
    w = Window.partitionBy(*TABLE, "col").orderBy("row").rangeBetween(-1, -1)
    c = cells.withColumn("above", F.first("text").over(w))
    full, over = F.col("text") != "", F.coalesce(F.col("above"), F.lit("")) != ""
    goes_on = T.is_lower_case(F.substring("text", 1, 1)) | T.can_be_connected("above") | T.is_dash_wrapped("above")
    rows = c.groupBy(*TABLE, "row").agg(F.count_if(full).alias("n"), F.count_if(over).alias("m"), F.bool_and(~full | (over & T.has_alphabets("text") & F.coalesce(goes_on, F.lit(False)))).alias("ok"))
    joined = (F.col("row") > 1) & (F.col("n") > 0) & (F.col("n") <= F.col("m")) & F.col("ok")
    r = Window.partitionBy(*TABLE).orderBy("row")
    into = F.last(F.when(~joined, F.col("row")), ignorenulls=True).over(r)
    return rows.withColumn("into", into).where(joined).select(*TABLE, "row", "into")


def merge_wrapped(cells: DataFrame) -> DataFrame:
    """Cells with wrapped rows joined to the row that they go on; rows are numbered anew."""
    to = cells.join(wrapped_rows(cells), [*TABLE, "row"], "left").withColumn("into", F.coalesce("into", "row"))
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), lambda t: t != "")
    merged = to.groupBy(*TABLE, "into", "col").agg(F.array_join(parts, "\n").alias("text"))
    return merged.withColumn("row", (F.dense_rank().over(Window.partitionBy(*TABLE).orderBy("into")) - 1).cast("int")).select(*TABLE, "row", "col", "text")


def column_titles(cells: DataFrame, headers: int = 1) -> DataFrame:
    """(doc_id, table_id, col, title, path): a column's lowest header text, and all from the top parted by slashes."""
    head = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), lambda t: t != "")
    return cells.where(F.col("row") < headers).groupBy(*TABLE, "col").agg(head.alias("h")).select(*TABLE, "col", F.try_element_at("h", F.lit(-1)).alias("title"), F.array_join("h", "/").alias("path"))


def metadata(cells: DataFrame, headers: int = 1, caption: DataFrame | None = None, compat_millions: bool = False) -> DataFrame:
    """(doc_id, table_id, rows, columns, header_count, currency_symbol, currency_name, factor, statement, consolidated) of every table."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda x: x["text"]), "\t")
    t = cells.groupBy(*TABLE).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("columns"), texts.alias("__t"))
    t = t.join(caption, TABLE, "left") if caption is not None else t.withColumn("caption", F.lit(None).cast("string"))
    symbol = T.currency_symbol("__t")
    whole = F.concat_ws("\n", "caption", "__t")
    return t.select(*TABLE, "rows", "columns", F.lit(headers).alias("header_count"), symbol.alias("currency_symbol"), T.currency_name(symbol).alias("currency_name"), T.multiplicative_factor(whole, compat_millions).alias("factor"),
                    T.statement_type("caption").alias("statement"), F.coalesce(T.is_consolidated("caption"), F.lit(False)).alias("consolidated"))


def spanning_pages(elements: DataFrame) -> DataFrame:
    """(doc_id, table_id, pages): pages that a table's elements stand on, in order."""
    return elements.groupBy(*TABLE).agg(F.sort_array(F.collect_set("page_no")).alias("pages"))


def table_text(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, text): cells parted by tabs, rows by line feeds."""
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), "\t")
    lined = cells.groupBy(*TABLE, "row").agg(rows.alias("line"))
    return lined.groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))


def reassign_by_overlap(elements: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Elements with ``col`` as the column whose boundaries they share most width with; others keep theirs."""
    e = elements if "table_id" in elements.columns else elements.withColumn("table_id", F.lit(0))
    both = e.select(*TABLE, "elem_idx", "left", "width").join(boundaries.withColumnRenamed("col", "__c"), TABLE).withColumn("o", G.overlap("left", F.col("left") + F.col("width"), "lo", "hi")).where("o > 0")
    best = both.groupBy(*TABLE, "elem_idx").agg(F.max_by("__c", F.struct("o", -F.col("__c"))).alias("__best"))
    return e.join(best, [*TABLE, "elem_idx"], "left").withColumn("col", F.coalesce("__best", "col")).drop("__best")
