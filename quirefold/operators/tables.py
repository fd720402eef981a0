"""Splitting of tables by votes, merging of narrow columns, and total rows by words, style and borders.

Cells are rows (doc_id, table_id, row, col, text) with, where known, ``styles``, ``rgb``, ``height``, ``width``, ``n_elements``,
``font_size``, ``font_family`` and border flags of their first element.  An empty text is an empty cell.

Defined results: absent or null styles are none, a null colour is black, null borders are absent; ties do not occur, as a
place has one cell; a table without rows gives none; other columns pass.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .algebra import TABLE, drop_long_runs, header_counts, header_score

LIMITS, LEAST_ROWS, VARIES, ROW_BASED = (0.4, 0.8, 0.6, 0.6), 2, 0.15, 0.5
CONFIDENT, NARROW, LONGEST = 0.8, 10.8, 3
SPREAD = (0.2135, 0.0, 0.112, 0.10042)


def _have(cells: DataFrame, **kinds: str) -> DataFrame:
    """Cells with the columns that are asked for, null where they had none."""
    return cells.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in cells.columns})


def row_votes(cells: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, table_id, row, filled, style, regex, colour, font, fill, bold, ``more``): how many cells of a row break with the one above.

    Styles and kinds are compared within a column.  Colour and filling are compared along the columns one after the other,
    so a column's first cell follows the last of the column before.  A font vote goes to a row higher than the one above
    whose next row is lower again, by more than 15 %.
    """
    c = _have(cells, styles="array<string>", rgb="int", height="double").withColumn("full", F.col("text") != "")
    down, on = Window.partitionBy(*TABLE, "col").orderBy("row"), Window.partitionBy(*TABLE).orderBy("col", "row")
    styled = F.col("full") & F.col("styles").isNotNull() & (F.size("styles") > 0)
    none = F.array().cast("array<string>")
    style = F.when(styled, F.col("styles")).otherwise(none)
    kind = F.when(F.col("full"), T.regex_type(F.trim("text"))).otherwise(T.NON_ALPHANUMERIC)
    paint = F.when(F.col("full") & (F.col("rgb") != 0), F.col("rgb"))
    h = F.when(F.col("full"), F.coalesce("height", F.lit(0.0))).otherwise(0.0)
    c = c.withColumns({"__style": style, "__kind": kind, "__paint": paint, "__h": h})
    before = F.lag("__h", 1, 0.0).over(down)
    # a height after none rises without bound
    change = F.when(before == 0, F.when(F.col("__h") > 0, float("inf"))).otherwise(F.col("__h") / before - 1)
    c = c.withColumn("__change", change)
    drop = F.lead("full").over(down) & (F.lead("__change").over(down) < -VARIES) & (F.col("__change") > VARIES)
    votes = {
        "style": styled & (F.col("__style") != F.coalesce(F.lag("__style").over(down), none)), "regex": F.col("full") & (F.col("__kind") != F.lag("__kind", 1, T.NON_ALPHANUMERIC).over(down)),
        "colour": F.col("__paint").isNotNull() & ~F.col("__paint").eqNullSafe(F.lag("__paint").over(on)), "font": F.coalesce(drop, F.lit(False)), "fill": F.col("full") != F.lag("full", 1, False).over(on),
        "bold": styled & F.array_contains("styles", "bold"),
    }
    c = c.withColumns({f"__{k}": v for k, v in votes.items()})
    return c.groupBy(*TABLE, "row").agg(F.count_if("full").alias("filled"), *[F.count_if(f"__{k}").alias(k) for k in votes], *more)


def split_candidates(cells: DataFrame, row_based: DataFrame | None = None) -> DataFrame:
    """(doc_id, table_id, row, p0, p1, p2, p3): rows, the third at the earliest and not the last, that may begin another table.

    The products of shares are style x kind x bold, colour x bold, filling x kind and filling x style, against 0.4, 0.8, 0.6
    and 0.6.  In a row-based table a font vote, or 0.5 of the last product, is enough.
    """
    return _candidates(cells, row_based).select(*TABLE, "row", "p0", "p1", "p2", "p3")


def _candidates(cells: DataFrame, row_based: DataFrame | None, judge: bool = False, header_rows: int = 1) -> DataFrame:
    """Candidates of splits; if they are to be judged, with ``__c``, the confidence of a header of so many rows.

    Sizes and headers are found from the rows of votes, by windows over the shuffle that these rest on: no cell is joined.
    """
    table = Window.partitionBy(*TABLE)
    v = row_votes(cells, F.max("col").alias("__col"), *([F.struct(*header_counts()).alias("__head")] if judge else []))
    v = v.withColumns({"__rows": F.max("row").over(table) + 1, "__cols": F.max("__col").over(table) + 1})
    if judge:
        scores = F.collect_list(header_score(lambda c: F.col(f"__head.{c}"))).over(table.orderBy("row").rangeBetween(0, header_rows - 1))
        v = v.withColumn("__scores", scores)
    share = lambda c: F.try_divide(F.col(c), F.col("filled"))
    fill = F.col("fill") / F.col("__cols")
    v = v.withColumns({"p0": share("style") * share("regex") * share("bold"), "p1": share("colour") * share("bold"), "p2": fill * share("regex"), "p3": fill * share("style")})
    over = F.lit(False)
    for k, least in enumerate(LIMITS):
        over = over | F.coalesce(F.col(f"p{k}") >= least, F.lit(False))
    if row_based is not None:
        v = v.join(row_based.select(*TABLE, F.lit(True).alias("__based")).distinct(), list(TABLE), "left")
        over = over | (F.coalesce("__based", F.lit(False)) & ((F.col("font") > 0) | F.coalesce(F.col("p3") >= ROW_BASED, F.lit(False))))
    found = v.where((F.col("row") >= LEAST_ROWS) & (F.col("row") < F.col("__rows") - 1) & over)
    if not judge:
        return found
    # the mean of the rows before the first weak one
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(True).alias("on"))
    add = lambda a, x: F.struct((a["s"] + F.when(a["on"] & (x > 0), x).otherwise(0.0)).alias("s"), (a["n"] + (a["on"] & (x > 0)).cast("int")).alias("n"), (a["on"] & (x > 0)).alias("on"))
    return found.withColumn("__c", F.aggregate("__scores", none, add, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(0.0)))


def split_confidence(headers: Column) -> Column:
    """Confidence of a split: half by how far the products exceed their limits, half by the header's confidence below."""
    hit = [F.coalesce(F.col(f"p{k}") >= least, F.lit(False)) for k, least in enumerate(LIMITS)]
    part = [F.when(h & F.lit(s > 0), (F.col("p0") - LIMITS[0]) / (s or 1.0)).otherwise(0.0) for h, s in zip(hit, SPREAD, strict=True)]
    n = sum((h.cast("int") for h in hit), F.lit(0))
    return 0.5 * F.coalesce(F.try_divide(sum(part, F.lit(0.0)), n), F.lit(0.0)) + 0.5 * headers


def splits(cells: DataFrame, row_based: DataFrame | None = None, least: float = CONFIDENT, header_rows: int = 1) -> DataFrame:
    """(doc_id, table_id, row, confidence): the first candidate of each table below which a header of ``least`` confidence stands.

    What stands below is judged by its first ``header_rows`` rows.  Apply it again to the lower part for further splits.
    """
    c = cells.withColumns({"highlighted": F.exists(F.coalesce("styles", F.array().cast("array<string>")), lambda s: s.isin("bold", "italic")), "coloured": F.coalesce(F.col("rgb") != 0, F.lit(False))}) if {"styles", "rgb"} <= set(cells.columns) else cells
    c = c.withColumns({f: F.lit(False) for f in ("highlighted", "coloured") if f not in c.columns})
    good = _candidates(c, row_based, True, header_rows).where(F.col("__c") >= least).withColumn("confidence", split_confidence(F.col("__c")))
    return good.groupBy(*TABLE).agg(F.min("row").alias("row"), F.min_by("confidence", "row").alias("confidence"))


def split_at(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Cells with ``part``: 0 above the row of ``found``, 1 from it on; rows and columns are numbered anew, empty columns go."""
    c = cells.join(found.select(*TABLE, F.col("row").alias("__at")), list(TABLE), "left")
    c = c.withColumn("part", F.when(F.col("row") >= F.col("__at"), 1).otherwise(0)).withColumn("row", F.when(F.col("part") == 1, F.col("row") - F.col("__at")).otherwise(F.col("row")).cast("int")).drop("__at")
    some = F.max((F.col("text") != "").cast("int")).over(Window.partitionBy(*TABLE, "part", "col")) == 1
    kept = c.withColumn("__some", some).where("__some").drop("__some")
    return kept.withColumn("col", (F.dense_rank().over(Window.partitionBy(*TABLE, "part").orderBy("col")) - 1).cast("int"))


def merge_narrow_columns(cells: DataFrame, headers: int = 1) -> DataFrame:
    """Cells (doc_id, table_id, row, col, text) after each column has taken the narrow ones right of it.

    A column takes the next one where that is 10.8 points wide at most in every row, its last header cell is empty while the
    column's own is not, and of the two cells of every other row one is empty, or the first is a currency sign alone.  The
    next one after is then compared with the merged column.  One Arrow group a table, which its cells bound.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        at_row, at_col, words, widths = (rows.column(c).to_pylist() for c in ("row", "col", "text", "width"))
        n_rows, n_cols = max(at_row) + 1, max(at_col) + 1
        texts = [[[] for _ in range(n_cols)] for _ in range(n_rows)]
        narrow = [True] * n_cols
        for r, c, t, w in zip(at_row, at_col, words, widths, strict=True):
            if t:
                texts[r][c].append(t)
                narrow[c] &= w <= NARROW
        k = 0
        while k < len(narrow) - 1:
            pair = [(row[k], row[k + 1]) for row in texts]
            fits = narrow[k + 1] and all((bool(a) and not b) if r == headers - 1 else (not a or not b or (len(a) == 1 and a[0] in ("$", "€"))) for r, (a, b) in enumerate(pair))
            if fits:
                for row in texts:
                    row[k] = row[k] + row.pop(k + 1)
                narrow[k] = False
                narrow.pop(k + 1)
            else:
                k += 1
        r, c, joined = zip(*((r, c, "\t".join(t)) for r, row in enumerate(texts) for c, t in enumerate(row)), strict=True)
        of = lambda k, name: pa.array([key[k].as_py()] * len(r), rows.schema.field(name).type)
        return pa.table({"doc_id": of(0, "doc_id"), "table_id": of(1, "table_id"), "row": pa.array(r, pa.int32()), "col": pa.array(c, pa.int32()), "text": pa.array(joined, pa.string())})

    source = _have(cells, width="double").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("table_id").cast("int").alias("table_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("width", F.lit(0.0)).alias("width"))
    return source.groupBy(*TABLE).applyInArrow(run, "doc_id bigint, table_id int, row int, col int, text string")


def total_rows(cells: DataFrame, headers: int = 1, lines_significant: bool = False, longest: int = LONGEST) -> DataFrame:
    """(doc_id, table_id, row): rows of totals.

    Rows with a number right of the first column are numeric; columns that are amounts or empty in all of them are numeric
    too.  Of two numeric rows or more, those that in a numeric column look different from the first row without styles, or
    (unless lines are significant) have a border under an amount, are candidates, if that does not hold for all of them.
    Of the candidates, or of all numeric rows if there are none, those that say total left of an amount are totals; without
    such words the candidates are, if any.  Longer runs than ``longest`` do not count.
    """
    flags = ("border_top", "grid_based", "underlined", "overlined")
    c = _have(cells, styles="array<string>", rgb="int", font_size="double", font_family="string", above_text="string", below_text="string", **dict.fromkeys(flags, "boolean")).where((F.col("row") >= headers) & (F.col("text") != ""))
    row, right = Window.partitionBy(*TABLE, "row"), Window.partitionBy(*TABLE, "row").orderBy("col")
    styles = F.array_sort(F.coalesce("styles", F.array().cast("array<string>")))
    # kinds are found once a cell; windows on a row come after that along it, whose order serves them too
    c = c.withColumns({"__kind": T.regex_type("text"), "__styles": styles}).withColumn("__amount", T.is_amount_representation("text", F.col("__kind")))
    c = c.withColumn("__total", T.means_total("text") & F.coalesce(F.lead("__amount").over(right), F.lit(False)))
    c = c.withColumns({"__num": F.max(((F.col("col") > 0) & (F.col("__kind") == T.NUMERIC)).cast("int")).over(row) == 1, "__plain": F.max((F.size("__styles") > 0).cast("int")).over(row) == 0}).where("__num").drop("__kind")
    table, column = Window.partitionBy(*TABLE), Window.partitionBy(*TABLE, "col")
    ref = F.coalesce(F.min(F.when(F.col("__plain"), F.col("row"))).over(table), F.min("row").over(table))
    c = c.withColumns({"__ref": ref, "__rows": F.size(F.collect_set("row").over(table))})
    c = c.withColumn("__numeric_col", (F.col("col") > 0) & F.min(F.col("__amount").cast("int")).over(column).eqNullSafe(1))
    look = F.struct("font_size", "font_family", F.coalesce("rgb", F.lit(0)).alias("rgb"), "__styles")
    c = c.withColumn("__look", F.max(F.when(F.col("row") == F.col("__ref"), look)).over(column))
    a = lambda f: F.col(f"__look.{f}")
    size = F.when(F.col("font_size").isNull() | a("font_size").isNull(), ~F.col("font_size").eqNullSafe(a("font_size"))).otherwise(F.abs(F.col("font_size") - a("font_size")) >= 0.15 * F.greatest(F.col("font_size"), a("font_size")))
    other = size | ~F.col("font_family").eqNullSafe(a("font_family")) | (F.coalesce("rgb", F.lit(0)) != a("rgb")) | (F.col("__styles") != a("__styles"))
    on = lambda f: F.coalesce(F.col(f), F.lit(False))
    ruled = on("border_top") & F.coalesce(T.is_amount_representation("above_text"), F.lit(False)) & ~on("grid_based") & (on("underlined") | F.col("below_text").isNull() | on("overlined") | F.coalesce(T.has_alphabets("below_text"), F.lit(False)))
    c = c.withColumns({"__other": F.col("__numeric_col") & F.col("__look").isNotNull() & other, "__ruled": F.col("__numeric_col") & ruled & F.lit(not lines_significant)})
    rows = c.groupBy(*TABLE, "row").agg(F.bool_or("__other").alias("other"), F.bool_or("__ruled").alias("ruled"), F.bool_or("__total").alias("total"), F.first("__rows").alias("n"))
    part = lambda f: (F.col("n") >= 2) & F.col(f) & (F.count_if(F.col(f)).over(table) < F.col("n"))
    rows = rows.withColumn("candidate", part("other") | part("ruled")).withColumn("some", F.max(F.col("candidate").cast("int")).over(table) == 1)
    rows = rows.withColumn("said", F.col("total") & (F.col("candidate") | ~F.col("some")))
    rows = rows.withColumn("any_said", F.max(F.col("said").cast("int")).over(table) == 1)
    fewer = F.count_if("candidate").over(table) < F.col("n")
    rows = rows.withColumn("chosen", F.when(F.col("any_said"), F.col("said")).otherwise(F.col("candidate") & fewer))
    return drop_long_runs(rows.where("chosen").select(*TABLE, "row"), longest)
