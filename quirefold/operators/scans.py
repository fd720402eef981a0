"""Walks over elements in order, predicates of the element tree, and small joins that other operators rest on.

All are windows or equi-joins on the document.  Defined results: ties go by ``elem_idx``; null flags count as false; null
sizes as 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = ("doc_id", "page_no")
TABLE = ("doc_id", "table_id")
#: What a kind of element is: inline, able to give text, a delimiter, without children.
INLINE, TEXTUAL, DELIMITERS = ("text", "image", "form", "inline_block"), ("text", "form"), ("hline", "vline", "page_break")


def kind_traits(elements: DataFrame) -> DataFrame:
    """Elements with ``is_inline``, ``has_text``, ``is_delimiter`` and ``is_terminal``."""
    k = F.coalesce("kind", F.lit(""))
    return elements.withColumns({"is_inline": k.isin(*INLINE), "has_text": k.isin(*TEXTUAL), "is_delimiter": k.isin(*DELIMITERS), "is_terminal": k.isin(*INLINE, *DELIMITERS) & (k != "inline_block")})


def scan(elements: DataFrame, starts: Column, wanted: Column, stop: Column, forward: bool = True, own: bool = False, within: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(within, start_idx, elem_idx): from each start, the wanted elements after it (or before) up to the next one that stops.

    Stops cut the order in spells; a start sees the rest of its own spell, and itself only with ``own``.
    """
    w = Window.partitionBy(*within).orderBy("elem_idx" if forward else F.desc("elem_idx"))
    hit = F.coalesce(stop, F.lit(False))
    # a stop ends the spell of those before it, and begins its own
    marked = elements.withColumns({"__spell": F.count_if(hit).over(w), "__start": F.coalesce(starts, F.lit(False)), "__want": F.coalesce(wanted, F.lit(False))})
    a = marked.where("__start").select(*within, "__spell", F.col("elem_idx").alias("start_idx"))
    b = marked.where("__want").select(*within, "__spell", "elem_idx")
    after = (F.col("elem_idx") > F.col("start_idx")) if forward else (F.col("elem_idx") < F.col("start_idx"))
    return a.join(b, [*within, "__spell"]).where(after | (F.lit(own) & (F.col("elem_idx") == F.col("start_idx")))).select(*within, "start_idx", "elem_idx")


def kth_position(elements: DataFrame, wanted: Column, k: int, last: bool = False, within: tuple[str, ...] = PAGE) -> DataFrame:
    """(within, size): elements from the page's beginning (or end) to the k-th wanted one; 0 where there are fewer, or k is 0."""
    w = Window.partitionBy(*within).orderBy(F.desc("elem_idx") if last else "elem_idx")
    placed = elements.withColumns({"__at": F.row_number().over(w), "__n": F.count_if(F.coalesce(wanted, F.lit(False))).over(w)})
    return placed.groupBy(*within).agg(F.coalesce(F.min(F.when((F.col("__n") == k) & F.lit(k > 0), F.col("__at"))), F.lit(0)).alias("size"))


def interline_space(elements: DataFrame, upwards: bool = False) -> DataFrame:
    """Elements with ``space`` to the next one of the page in the walk's direction, top to bottom whichever it is."""
    w = Window.partitionBy(*PAGE).orderBy("elem_idx")
    bottom = lambda t, h: t + F.coalesce(h, F.lit(0.0))
    down = F.lead("top").over(w) - bottom(F.col("top"), F.col("height"))
    up = F.col("top") - bottom(F.lag("top").over(w), F.lag("height").over(w))
    return elements.withColumn("space", up if upwards else down)


def gap_middle(elements: DataFrame) -> DataFrame:
    """Elements with ``split_at``: halfway between an element's right edge and the next one's left on its line."""
    w = Window.partitionBy(*PAGE, "line").orderBy("left", "elem_idx")
    return elements.withColumn("split_at", (F.col("left") + F.col("width") + F.lead("left").over(w)) / 2)


def filled_upwards(cells: DataFrame) -> DataFrame:
    """Cells with ``above``: the text of the nearest cell above in the column that is not empty, their own included."""
    w = Window.partitionBy(*TABLE, "col").orderBy("row")
    return cells.withColumn("above", F.last(F.nullif("text", F.lit("")), ignorenulls=True).over(w))


def share_elements(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two tables of collections (``keys``, name, ids) whose collections have an element in common."""
    left = a.select(*keys, F.col("name").alias("a_name"), F.explode("ids").alias("id"))
    right = b.select(*keys, F.col("name").alias("b_name"), F.explode("ids").alias("id"))
    return left.join(right, [*keys, "id"]).select(*keys, "a_name", "b_name").distinct()


def segment_groups(groups: DataFrame) -> DataFrame:
    """(doc_id, elem_idx, first_idx): for the elements of groups of several, the group's first."""
    w = Window.partitionBy("doc_id", "grp")
    return groups.withColumns({"first_idx": F.min("elem_idx").over(w), "__n": F.count("*").over(w)}).where("__n > 1").select("doc_id", "elem_idx", "first_idx")


def hand_written(areas: DataFrame) -> DataFrame:
    """(doc_id, page_no, left, top, width, height), to two decimals downwards, of areas tagged as written by hand."""
    return areas.where("tag = 'hand_written'").select(*PAGE, *[T.floor2(c).alias(c) for c in ("left", "top", "width", "height")])


def without_tables(context: DataFrame, deleted: DataFrame) -> DataFrame:
    """Elements' table places, null for the tables that ``deleted`` (doc_id, table_id) names; the others are numbered anew."""
    gone = deleted.select("doc_id", "table_id", F.lit(True).alias("__gone")).distinct()
    marked = context.join(gone, ["doc_id", "table_id"], "left")
    keep = F.col("__gone").isNull() & F.col("table_id").isNotNull()
    w = Window.partitionBy("doc_id").orderBy(F.when(keep, 0).otherwise(1), "table_id")
    number = F.when(keep, (F.dense_rank().over(w) - 1).cast("int"))
    others = [c for c in context.columns if c not in ("doc_id", "elem_idx", "table_id", "t_row", "t_col")]
    return marked.withColumn("__new", number).select("doc_id", "elem_idx", F.col("__new").alias("table_id"), *[F.when(keep, F.col(c)).alias(c) for c in ("t_row", "t_col") if c in context.columns], *others)


def curtail_valid(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, table_id, valid): whether all elements of the rows cut from an earlier table are in the new header."""
    r = rows.join(headers.select("doc_id", "elem_idx", F.lit(True).alias("__in")).distinct(), ["doc_id", "elem_idx"], "left")
    return r.groupBy(*TABLE).agg(F.bool_and(F.col("__in").isNotNull()).alias("valid"))


def noise(elements: DataFrame, patterns: list[str]) -> DataFrame:
    """Elements with ``is_noise``: one of the patterns matches their whole text."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(T.matches("text", p), F.lit(False))
    return elements.withColumn("is_noise", hit)


def aligned_with_columns(elements: DataFrame, columns: DataFrame, near: float = 3.0) -> DataFrame:
    """Elements with ``aligned``: whether some column (doc_id, table_id, lo, hi) begins or ends within ``near`` points of their edges."""
    e = elements.select(*TABLE, "elem_idx", F.col("left").alias("__l"), (F.col("left") + F.col("width")).alias("__r"))
    hit = e.join(columns, list(TABLE)).where((F.abs(F.col("__l") - F.col("lo")) <= near) | (F.abs(F.col("__r") - F.col("hi")) <= near)).select(*TABLE, "elem_idx").distinct()
    return elements.join(hit.withColumn("aligned", F.lit(True)), [*TABLE, "elem_idx"], "left").withColumn("aligned", F.coalesce("aligned", F.lit(False)))


def grid_based_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, grid_based, empty): every filled cell has a border at top, left and right; no cell is filled."""
    filled = F.col("text") != ""
    ruled = F.coalesce(F.col("border_top"), F.lit(False)) & F.coalesce(F.col("border_left"), F.lit(False)) & F.coalesce(F.col("border_right"), F.lit(False))
    return cells.groupBy(*TABLE, "row").agg(F.coalesce(F.bool_and(F.when(filled, ruled)), F.lit(False)).alias("grid_based"), F.bool_and(~filled).alias("empty"))


def image_strings(glyphs: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page_no, seq, text): the sign read from the nearest image left of a digit on its line, nearer than two digits' width.

    An as-of join by a window over digits and images of a line in order of x; one that an earlier glyph follows is not the digit's.
    """
    digit = F.regexp_like("ch", F.lit("[0-9]"))
    g = glyphs.select(*PAGE, "line", "x", "seq", "width", digit.alias("digit"), F.lit(None).cast("string").alias("sign"))
    i = images.select(*PAGE, "line", "x", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("double").alias("width"), F.lit(False).alias("digit"), F.col("text").alias("sign"))
    w = Window.partitionBy(*PAGE, "line").orderBy("x", F.coalesce("seq", F.lit(-1)), "sign").rowsBetween(Window.unboundedPreceding, -1)
    both = g.unionByName(i).withColumns({"__sx": F.last(F.when(F.col("sign").isNotNull(), F.col("x")), ignorenulls=True).over(w), "__s": F.last("sign", ignorenulls=True).over(w), "__gx": F.last(F.when(F.col("sign").isNull(), F.col("x")), ignorenulls=True).over(w)})
    fits = F.col("digit") & (F.col("x") - F.col("__sx") < 2 * F.col("width")) & (F.col("__gx").isNull() | (F.col("__sx") > F.col("__gx")))
    return both.where(fits).select(*PAGE, "seq", F.col("__s").alias("text"))


def plural_header(elements: DataFrame, below: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, elem_idx): elements with several below on the first one's line whose texts have three signs or more.

    ``below`` holds (doc_id, elem_idx, ids), ids in order.
    """
    e = elements.select("doc_id", F.col("elem_idx").alias("id"), "top", "height", F.length("text").alias("n"))
    each = below.select("doc_id", "elem_idx", F.posexplode("ids").alias("k", "id")).join(e, ["doc_id", "id"])
    w = Window.partitionBy("doc_id", "elem_idx").orderBy("k")
    t0, b0 = F.first("top").over(w), F.first(F.col("top") + F.col("height")).over(w)
    on = (F.least(b0, F.col("top") + F.col("height")) > F.greatest(t0, F.col("top"))) & (F.col("n") >= least)
    return each.withColumn("__on", on).groupBy("doc_id", "elem_idx").agg(F.count_if("__on").alias("n")).where("n > 1").select("doc_id", "elem_idx")


def underlined_border(elements: DataFrame) -> DataFrame:
    """Elements with ``underlined``: their lower border is nearer than their font's size and nearer to them than to the one below.

    Reads ``vis_bottom``, ``border_bottom`` and ``below_top``, the top of the element in the shadow below (null without one).
    """
    d = F.col("vis_bottom") - F.col("top") - F.col("height")
    return elements.withColumn("underlined", F.coalesce(F.col("border_bottom") & (d < F.col("font_size")) & (F.col("below_top").isNull() | (d < F.col("below_top") - F.col("vis_bottom"))), F.lit(False)))


def lines_outside(rules: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rules that no box (doc_id, page_no, top, left, width, height) contains."""
    b = boxes.select(*PAGE, F.col("top").alias("__t"), F.col("left").alias("__l"), (F.col("top") + F.col("height")).alias("__b"), (F.col("left") + F.col("width")).alias("__r"))
    r = rules.withColumns({"__x2": F.col("left") + F.when(F.col("kind") == "hline", F.col("stretch")).otherwise(0.0), "__y2": F.col("top") + F.when(F.col("kind") == "vline", F.col("stretch")).otherwise(0.0)})
    inside = (r["doc_id"] == b["doc_id"]) & (r["page_no"] == b["page_no"]) & (F.col("left") >= F.col("__l")) & (F.col("__x2") <= F.col("__r")) & (F.col("top") >= F.col("__t")) & (F.col("__y2") <= F.col("__b"))
    return r.join(b, inside, "left_anti").drop("__x2", "__y2")


def form_elements(fields: DataFrame, annotations: DataFrame) -> DataFrame:
    """Elements of form fields, each on the page that holds its key: (doc_id, page_no, elem_idx, kind, top, left, width, height, text, font_size, checked).

    Push buttons are left out.  A field without a font size has 2 points less than its height, or 12 if it is 14 high or more.
    """
    on = annotations.select("doc_id", "key", "page_no")
    placed = fields.where("type <> 'push_button'").join(on, ["doc_id", "key"])
    w = Window.partitionBy("doc_id").orderBy("page_no", "top", "left", "key")
    size = F.coalesce("font_size", F.when(F.col("height") < 14, F.col("height") - 2).otherwise(12.0))
    button = F.when(F.col("type") == "button", F.col("on").isNull() | F.exists("values", lambda v: F.array_contains("on", v)))
    return placed.select("doc_id", "page_no", (F.row_number().over(w) - 1).cast("int").alias("elem_idx"), F.lit("form").alias("kind"), "top", "left", "width", "height", F.array_join("values", ",").alias("text"), size.alias("font_size"), button.alias("checked"))


def ocr_phrases(words: DataFrame, spaces: float = 4.0) -> DataFrame:
    """(doc_id, page_no, phrase, text, left, top, width, height, font_size, styles) from words that a reader of images found.

    Words stand in lines, from the top and then from the left; a phrase ends where the next word stands below the line or
    more than four spaces away.  Sizes are averages; bold and italic hold where more than half of the words are.
    """
    w = Window.partitionBy(*PAGE).orderBy("top", "left", "word_id")
    below = F.lag("top").over(w).isNull() | (F.col("top") >= F.max(F.col("top") + F.col("height")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    lined = words.withColumn("__b", below).withColumn("line", F.count_if("__b").over(w))
    v = Window.partitionBy(*PAGE, "line").orderBy("left", "word_id")
    end = F.lag(F.col("left") + F.col("width")).over(v)
    far = end.isNull() | (F.col("left") - end > spaces * F.lag("space_width").over(v))
    cut = lined.withColumn("__far", far).withColumn("phrase", F.count_if("__far").over(Window.partitionBy(*PAGE).orderBy("line", "left", "word_id")) - 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "word_id", "text"))), lambda x: x["text"]), " ")
    half = lambda c: F.count_if(c) * 2 > F.count("*")
    out = cut.groupBy(*PAGE, "phrase").agg(text.alias("text"), F.min("left").alias("left"), F.avg("top").alias("top"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"), F.avg("height").alias("height"), F.avg("font_size").alias("font_size"), half("bold").alias("b"), half("italic").alias("i"))
    styles = F.array_compact(F.array(F.when(F.col("b"), "bold"), F.when(F.col("i"), "italic")))
    return out.select(*PAGE, F.col("phrase").cast("int").alias("phrase"), "text", "left", "top", "width", "height", "font_size", styles.alias("styles"))


def dark_box(pixels: DataFrame) -> DataFrame:
    """(image_id, left, top, right, bottom): where the pixels of an image (x, y, rgb) are dark, luminance below a half; none for a pale one."""
    return pixels.where(T.luminance("rgb") < 0.5).groupBy("image_id").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"))


def with_metrics(elements: DataFrame, name: str = "layout"):  # noqa: ANN201
    """The elements, counted as they pass, and the observation that holds the counts once an action has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return elements.observe(seen, F.count("*").alias("elements_total"), F.count_if(F.col("kind") == "text").alias("text_elements_total"), F.count_if(F.col("elem_idx") == 0).alias("documents_total"), F.max("page_no").alias("last_page")), seen
