"""Texts set as glyphs: the relation that a page's text operations give, a row a glyph.

A line of text is one operation.  Signs stand 6 points apart, with 8 points more after a comma and 24 more after a full
stop; capitals are set in a bold face, digits in an oblique one.  Colours, backgrounds, clips, tilts and modes vary with
the place, so that every rule of the filter meets some glyphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GLYPHS = (
    "doc_id bigint, page_no int, seq bigint, op int, ch string, x double, y double, width double, height double, font_name string, font_weight double, font_size double, space_per_size double, space_width double, "
    "scale_x double, shear_y double, mode string, fill_rgb int, fill_alpha double, stroke_rgb int, stroke_alpha double, luminous boolean, bg_rgb int, bg_op int, inside_clip boolean"
)
LEFT, TOP, CHAR, LINE, HEIGHT = 72, 100, 6, 14, 8
WHITE, PALE, BLUE = 0xFFFFFF, 0xF0F0F0, 0x0000FF
#: Bytes of a table as the planner knows it that are set as glyphs in one task; a sign becomes a row of some 300 bytes.
PORTION = 1 << 20


def by_document(texts: DataFrame, portion: int = PORTION) -> DataFrame:
    """The texts shuffled on their document, in as many parts as their glyphs need: glyphs, many times larger, are then not shuffled."""
    spark = texts.sparkSession
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return texts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // portion + 1), "doc_id")


def typeset(texts: DataFrame) -> DataFrame:
    """Glyphs of (doc_id, page_no, text); null and empty texts have none."""
    lines = texts.where("text IS NOT NULL").select("doc_id", "page_no", F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    spots = lines.where(F.length("s") > 0).select("doc_id", "page_no", "line", "s", F.explode(F.sequence(F.lit(0), F.length("s") - 1)).alias("col"))
    before = F.substr("s", F.lit(1), F.col("col"))
    count = lambda sign: F.length(before) - F.length(F.replace(before, F.lit(sign), F.lit("")))
    g = spots.select("doc_id", F.col("page_no").cast("int").alias("page_no"), "line", "col", F.substr("s", F.col("col") + 1, F.lit(1)).alias("ch"), (LEFT + CHAR * F.col("col") + 8 * count(",") + 24 * count(".")).cast("double").alias("x"), ((F.col("line") * 7 + F.col("col")) % 97).alias("k"))
    k, line, col = F.col("k"), F.col("line"), F.col("col")
    upper, digit = F.regexp_like("ch", F.lit("[A-Z]")), F.regexp_like("ch", F.lit("[0-9]"))
    pale = line % 13 == 4
    return g.select(
        "doc_id", "page_no", (line.cast("bigint") * 2**32 + col).cast("bigint").alias("seq"), (line + 1).cast("int").alias("op"), "ch", "x", (TOP + LINE * line).cast("double").alias("y"), F.lit(float(CHAR)).alias("width"),
        F.when(k == 11, 40.0).otherwise(float(HEIGHT)).alias("height"), F.when(upper, "ABCDEF+Helvetica").when(digit, "Courier-Oblique").otherwise("TimesNewRomanPSMT").alias("font_name"), F.when(upper, 700.0).otherwise(400.0).alias("font_weight"),
        F.when(digit, 14.0).otherwise(10.0).alias("font_size"), F.when(digit, 0.0).otherwise(500.0).alias("space_per_size"), F.when(upper & (line % 7 == 3), 1.5).otherwise(5.0).alias("space_width"),
        F.lit(1.0).alias("scale_x"), F.when(k == 4, 0.2).otherwise(0.0).alias("shear_y"), F.when(k == 0, "neither").when(k == 5, "both").otherwise("fill").alias("mode"),
        F.when(k == 1, WHITE).when(k == 2, PALE).when(k.between(6, 9), BLUE).otherwise(0).alias("fill_rgb"), F.when(k == 3, 0.0).otherwise(1.0).alias("fill_alpha"), F.lit(0).alias("stroke_rgb"), F.lit(1.0).alias("stroke_alpha"), (k == 10).alias("luminous"),
        F.when(pale, PALE).alias("bg_rgb"), F.when(pale & (line % 2 == 0), line + 2).when(pale, 0).cast("int").alias("bg_op"), (~((line % 5 == 2) & (col < 2))).alias("inside_clip"),
    )


def rules(glyphs: DataFrame) -> DataFrame:
    """Ruling lines of every page: an upright one at 200 points from the third to the twelfth line, a level one under the fourth."""
    pages = glyphs.select("doc_id", "page_no").distinct()
    upright = pages.select("doc_id", "page_no", F.lit("vline").alias("kind"), F.lit(float(TOP + 1.5 * LINE)).alias("top"), F.lit(205.0).alias("left"), F.lit(9.0 * LINE).alias("stretch"))
    return upright.unionByName(pages.select("doc_id", "page_no", F.lit("hline").alias("kind"), F.lit(float(TOP + 3 * LINE + 1)).alias("top"), F.lit(float(LEFT)).alias("left"), F.lit(120.0).alias("stretch")))


SQL = f"""
set_lines AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS line FROM texts WHERE text IS NOT NULL),
set_spots AS (SELECT *, unnest(range(length(s))) AS col FROM set_lines WHERE length(s) > 0),
set_signs AS (SELECT doc_id, page_no, line, col, substr(s, col + 1, 1) AS ch, substr(s, 1, col) AS b, (line * 7 + col) % 97 AS k FROM set_spots),
glyphs AS (SELECT doc_id, page_no, line * 4294967296 + col AS seq, line + 1 AS op, ch, ({LEFT} + {CHAR} * col + 8 * (length(b) - length(replace(b, ',', ''))) + 24 * (length(b) - length(replace(b, '.', ''))))::DOUBLE AS x, ({TOP} + {LINE} * line)::DOUBLE AS y, {CHAR}::DOUBLE AS width,
  CASE WHEN k = 11 THEN 40.0 ELSE {HEIGHT}.0 END::DOUBLE AS height, CASE WHEN ch BETWEEN 'A' AND 'Z' THEN 'ABCDEF+Helvetica' WHEN ch BETWEEN '0' AND '9' THEN 'Courier-Oblique' ELSE 'TimesNewRomanPSMT' END AS font_name, CASE WHEN ch BETWEEN 'A' AND 'Z' THEN 700 ELSE 400 END AS font_weight,
  CASE WHEN ch BETWEEN '0' AND '9' THEN 14.0 ELSE 10.0 END::DOUBLE AS font_size, CASE WHEN ch BETWEEN '0' AND '9' THEN 0 ELSE 500 END::DOUBLE AS space_per_size, CASE WHEN ch BETWEEN 'A' AND 'Z' AND line % 7 = 3 THEN 1.5 ELSE 5.0 END::DOUBLE AS space_width,
  1.0::DOUBLE AS scale_x, CASE WHEN k = 4 THEN 0.2 ELSE 0.0 END::DOUBLE AS shear_y, CASE WHEN k = 0 THEN 'neither' WHEN k = 5 THEN 'both' ELSE 'fill' END AS mode,
  CASE WHEN k = 1 THEN {WHITE} WHEN k = 2 THEN {PALE} WHEN k BETWEEN 6 AND 9 THEN {BLUE} ELSE 0 END AS fill_rgb, CASE WHEN k = 3 THEN 0.0 ELSE 1.0 END AS fill_alpha, k = 10 AS luminous,
  CASE WHEN line % 13 = 4 THEN {PALE} END AS bg_rgb, CASE WHEN line % 13 = 4 THEN CASE WHEN line % 2 = 0 THEN line + 2 ELSE 0 END END AS bg_op, NOT (line % 5 = 2 AND col < 2) AS inside_clip FROM set_signs)"""
