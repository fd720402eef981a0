"""Pages: merging to one, alignment, likeness across pages, running heads, scannedness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import Options
from . import lines as L

LETTER = (612.0, 792.0)
NEAR_LEFT, NEAR_TOP, NEAR_HEIGHT = 30.0, 30.0, 2.0


def page_offsets(pages: DataFrame) -> DataFrame:
    """Pages with ``y_offset``: the heights of all pages before."""
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("y_offset", F.coalesce(F.sum("height").over(w), F.lit(0.0)))


def merge_pages(elements: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements of one tall page with page breaks between, and that page's size; a document of one page stays as it is.

    The page is as large as what it holds, at least a letter's; sizes are whole points.
    """
    placed = page_offsets(pages)
    order = Window.partitionBy("doc_id").orderBy("page_no", "__k", "elem_idx")
    names = elements.columns
    moved = elements.join(placed.select("doc_id", "page_no", "y_offset"), ["doc_id", "page_no"]).withColumn("top", F.col("top") + F.col("y_offset")).withColumn("__k", F.lit(1)).drop("y_offset")
    breaks = placed.where("y_offset > 0").select("doc_id", "page_no", F.lit("page_break").alias("kind"), F.col("y_offset").alias("top"), F.lit(0.0).alias("left"), F.col("width").alias("stretch"), F.lit(0).alias("__k"), F.lit(-1).alias("elem_idx"))
    both = moved.unionByName(breaks, allowMissingColumns=True).withColumn("elem_idx", (F.row_number().over(order) - 1).cast("int")).select(*names)
    size = both.groupBy("doc_id").agg(F.greatest(F.max(F.col("left") + F.coalesce("width", F.lit(0.0))), F.lit(LETTER[0])).cast("int").cast("double").alias("w0"), F.max(F.col("top") + F.coalesce("height", F.lit(0.0))).alias("h0"))
    extent = pages.groupBy("doc_id").agg(F.max("width").alias("w1"), F.sum("height").alias("h1"))
    sized = extent.join(size, "doc_id", "left").select("doc_id", F.greatest(F.col("w1"), F.coalesce("w0", F.lit(LETTER[0]))).cast("int").cast("double").alias("width"), F.greatest(F.col("h1"), F.coalesce("h0", F.lit(0.0)), F.lit(LETTER[1])).cast("int").cast("double").alias("height"))
    return both, sized


def close_gaps(elements: DataFrame, most: float = 150.0) -> DataFrame:
    """Merged elements moved up so that no blank band between what stands above and below is higher than ``most``.

    The lowest bottom so far is a running maximum, so each element's shift is a running sum over its document.
    """
    w = Window.partitionBy("doc_id").orderBy("top", "elem_idx")
    reach = F.max(F.col("top") + F.coalesce("height", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    spare = F.greatest(F.col("top") - F.coalesce(reach, F.col("top")) - most, F.lit(0.0))
    return elements.withColumn("__spare", spare).withColumn("top", F.col("top") - F.sum("__spare").over(w)).drop("__spare")


def shift_areas(areas: Column, by: Column) -> Column:
    """Coloured or tagged areas moved down."""
    return F.transform(areas, lambda a: a.withField("y", a["y"] + by))


def line_alignment(elements: DataFrame, page_width: float = 612.0) -> DataFrame:
    """(doc_id, page_no, line, alignment) by the margins left and right of a line."""
    lined = L.with_lines(elements)
    per = lined.groupBy(*L.PAGE, "line").agg(F.min_by("left", "elem_idx").alias("l"), F.max_by(F.col("left") + F.col("width"), "elem_idx").alias("e"))
    left, right = F.col("l"), page_width - F.col("e")
    center = (left > 150) & (right > 150) & (F.abs(right - left) < 0.1 * left)
    return per.select(*L.PAGE, "line", F.when(left < 45, "EXTREME_LEFT").when(right < 45, "EXTREME_RIGHT").when(left > 2 * right, "RIGHT").when(center, "CENTER").otherwise("LEFT").alias("alignment"))


def repeated_across_pages(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, elem_idx, next_idx): elements that the next page has at the same place with the same words but numbers.

    Only elements that have one on the page before or after with the same signs but numerals are masked; those of the next page
    with the same mask are then listed by a second window over the same shuffle.  Of several the first counts.
    """
    a = elements.where("doc_id IS NOT NULL AND page_no IS NOT NULL").select("doc_id", "page_no", "elem_idx", "left", "top", "height", "text", T.without_numerals("text").alias("__key"))
    like = Window.partitionBy("doc_id", "__key").orderBy("page_no")
    beside = (F.count("*").over(like.rangeBetween(-1, -1)) > 0) | (F.count("*").over(like.rangeBetween(1, 1)) > 0)
    masked = a.withColumn("__beside", beside).where("__beside").withColumn("__mask", T.masked_numbers("text"))
    box = F.struct("elem_idx", "left", "top", "height")
    after = F.collect_list(box).over(Window.partitionBy("doc_id", "__key", "__mask").orderBy("page_no").rangeBetween(1, 1))
    near = lambda b: (F.abs(F.col("left") - b["left"]) < NEAR_LEFT) & (F.abs(F.col("top") - b["top"]) < NEAR_TOP) & (F.abs(F.col("height") - b["height"]) < NEAR_HEIGHT)
    found = masked.select("doc_id", "page_no", "elem_idx", "left", "top", "height", after.alias("__after")).withColumn("__hits", F.filter("__after", near)).where(F.size("__hits") > 0)
    return found.groupBy("doc_id", "page_no", "elem_idx").agg(F.min(F.array_min(F.transform("__hits", lambda b: b["elem_idx"]))).alias("next_idx"))


def repeated_within_page(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, elem_idx): elements whose text, styles, left edge and height another of the page has too."""
    a = elements.select("doc_id", "page_no", "elem_idx", "left", "height", "text", F.array_sort(F.array_distinct(F.coalesce("styles", F.array().cast("array<string>")))).alias("styles"))
    b = a.select("doc_id", "page_no", "text", "styles", F.col("elem_idx").alias("e2"), F.col("left").alias("l2"), F.col("height").alias("h2"))
    near = (F.col("elem_idx") != F.col("e2")) & (F.abs(F.col("left") - F.col("l2")) < NEAR_LEFT) & (F.abs(F.col("height") - F.col("h2")) < NEAR_HEIGHT)
    return a.join(b, ["doc_id", "page_no", "text", "styles"]).where(near).select("doc_id", "page_no", "elem_idx").distinct()


def head_and_foot_lines(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, line, text, is_head, is_foot): first and last lines with links, dates or a note that the page goes on."""
    lined = L.joined_text(L.with_lines(elements), ["doc_id", "page_no", "line"])
    w = Window.partitionBy(*L.PAGE)
    ends = lined.withColumn("last", F.max("line").over(w)).where("line = 0 OR line = last")
    head = (F.col("line") == 0) & (T.starts_as_header("text") | T.is_numeric_date(F.regexp_extract("text", r"^\s*(\S+)", 1)))
    return ends.select(*L.PAGE, "line", "text", head.alias("is_head"), T.continues_on_next_page("text").alias("is_foot"))


def page_numbers(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, elem_idx, text) of elements that are page numbers."""
    return elements.where(T.is_page_number("text")).select("doc_id", "page_no", "elem_idx", "text")


def scannedness(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, scannedness): a twentieth for each image alone between two texts, ten at most."""
    kinds = elements.where("kind IN ('text', 'image')")
    w = Window.partitionBy(*L.PAGE).orderBy("elem_idx")
    hit = (F.col("kind") == "image") & (F.lag("kind").over(w) == "text") & (F.lead("kind").over(w) == "text")
    per = kinds.withColumn("hit", hit.cast("int")).groupBy(*L.PAGE).agg(F.sum("hit").alias("n")).where("n > 0")
    return per.select(*L.PAGE, (F.least("n", F.lit(10)) / 20).alias("scannedness"))


def document_gates(elements: DataFrame, pages: DataFrame, allowed: float | None = None, min_chars: int = 0, options: Options | None = None) -> DataFrame:
    """(doc_id, chars, scannedness, undigitised): images' share of the pages, and whether a document must be read from images.

    It must where that share is above ``allowed`` (else the setting ``allowed_scannedness``), where it has fewer characters
    than ``min_chars``, or where all its pages hold images alone.
    """
    allowed = (options or Options()).allowed_scannedness if allowed is None else allowed
    area = elements.where("kind = 'image'").groupBy(*L.PAGE).agg(F.sum(F.col("width") * F.col("height")).alias("a"))
    share = pages.join(area, list(L.PAGE), "left").groupBy("doc_id").agg(F.avg(F.least(F.coalesce("a", F.lit(0.0)) / (F.col("width") * F.col("height")), F.lit(1.0))).alias("scannedness"))
    chars = elements.groupBy("doc_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    worded = elements.groupBy(*L.PAGE).agg(F.bool_or(F.col("kind") == "image").alias("i"), F.bool_or(F.col("kind") == "text").alias("t")).groupBy("doc_id").agg(F.bool_and(F.col("i") & ~F.col("t")).alias("__only"))
    both = share.join(chars, "doc_id", "left").join(worded, "doc_id", "left")
    few = F.coalesce("chars", F.lit(0)) < min_chars
    return both.select("doc_id", F.coalesce("chars", F.lit(0)).alias("chars"), "scannedness", ((F.col("scannedness") > allowed) | few | F.coalesce("__only", F.lit(False))).alias("undigitised"))


def splice(elements: DataFrame, replaced: DataFrame) -> DataFrame:
    """Elements with the pages that ``replaced`` holds taken from it."""
    pages = replaced.select(*L.PAGE).distinct()
    return elements.join(pages, list(L.PAGE), "left_anti").unionByName(replaced, allowMissingColumns=True)
