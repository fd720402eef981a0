"""Queries of walks, predicates and small joins, over texts laid out, grids and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions import text as T
from ..operators import lines as L
from ..operators import neighbours as N
from ..operators import pages as P
from ..operators import scans as O
from ..sources import glyphs
from ..sources import grid as G
from ..sources import text_layout as S
from .texts import LINED, WITH, Query, _elements

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _grid(spark: SparkSession, d: str, name: str) -> DataFrame:
    return G.elements(spark.read.parquet(f"{d}/{name}.parquet"), name)


def _cells(spark: SparkSession, d: str, name: str) -> DataFrame:
    return G.cells(spark.read.parquet(f"{d}/{name}.parquet"), name)


ORDERS, PARTS, LINES = (f"WITH {G.cells_sql(n)}" for n in ("orders", "part", "lineitem"))
_BOLD = "(regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[a-z]'))"


@query("derived_edges", f"""{WITH} SELECT doc_id, elem_idx, (top + height)::DOUBLE AS bottom, ("left" + width)::DOUBLE AS "right", ("left" + width / 2)::DOUBLE AS h_centre, (top + height / 2)::DOUBLE AS v_centre, top >= 100 AND top < 300 AS upper, "left" > 72 AND "left" < 200 AS indented FROM elements""")
def derived_edges(spark: SparkSession, d: str) -> DataFrame:
    e = geometry.derived(_elements(spark, d))
    return e.select("doc_id", "elem_idx", "bottom", "right", "h_centre", "v_centre", geometry.between_half("top", F.lit(100), F.lit(300)).alias("upper"), geometry.between_open("left", F.lit(72), F.lit(200)).alias("indented"))


@query("style_changes", f"""{WITH}, m AS (SELECT doc_id, page_no, elem_idx, {_BOLD} AS bold, lag({_BOLD}) OVER (PARTITION BY doc_id, page_no ORDER BY elem_idx) AS p FROM elements) SELECT doc_id, elem_idx FROM m WHERE bold <> p""")
def style_changes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = _elements(spark, d)
    look = F.struct("font_size", "font_family", "rgb", "styles")
    both = e.select("doc_id", "elem_idx", look.alias("b"), F.lag(look).over(Window.partitionBy("doc_id", "page_no").orderBy("elem_idx")).alias("a")).where("a IS NOT NULL")
    return both.where(geometry.other_style("a", "b")).select("doc_id", "elem_idx")


@query("element_paths", f"""{LINED} SELECT doc_id, elem_idx, 'page-' || page_no || '_group-' || grp || '_line-' || line || '_text-' || elem_idx AS path FROM grouped""")
def element_paths(spark: SparkSession, d: str) -> DataFrame:
    e = L.with_groups(L.with_lines(_elements(spark, d)))
    name = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
    return e.select("doc_id", "elem_idx", L.tree_path(name("page", "page_no"), name("group", "grp"), name("line", "line"), name("text", "elem_idx")).alias("path"))


def _pictured(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, "orders").withColumns({"kind": F.when((F.col("col") == 2) & (F.col("row") % 3 == 0), "image").otherwise("text"), "page_no": F.floor(F.col("row") / 8).cast("int")})


PICTURED = f"""{ORDERS}, pictured AS (SELECT *, "row" // 8 AS page_no, CASE WHEN col = 2 AND "row" % 3 = 0 THEN 'image' ELSE 'text' END AS kind FROM elements)"""


@query("scannedness", f"""{PICTURED}, n AS (SELECT *, kind = 'image' AND lag(kind) OVER w = 'text' AND lead(kind) OVER w = 'text' AS hit FROM pictured WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY elem_idx))
SELECT doc_id, page_no, round(least(count(*) FILTER (WHERE hit), 10) / 20.0, 6)::DOUBLE AS scannedness FROM n GROUP BY ALL HAVING count(*) FILTER (WHERE hit) > 0""")
def scannedness(spark: SparkSession, d: str) -> DataFrame:
    return P.scannedness(_pictured(spark, d)).select("doc_id", "page_no", F.round("scannedness", 6).alias("scannedness"))


@query("document_gates", f"""{PICTURED}, a AS (SELECT doc_id, page_no, least(coalesce(sum(width * height) FILTER (WHERE kind = 'image'), 0) / (612.0 * 792.0), 1.0) AS share FROM pictured GROUP BY ALL), s AS (SELECT doc_id, avg(share) AS share FROM a GROUP BY doc_id),
c AS (SELECT doc_id, sum(length(text)) AS chars FROM pictured GROUP BY doc_id) SELECT s.doc_id, chars, round(share, 9) AS scannedness, share > 0.0018 OR chars < 500 AS undigitised FROM s JOIN c ON s.doc_id = c.doc_id""")
def document_gates(spark: SparkSession, d: str) -> DataFrame:
    e = _pictured(spark, d)
    return P.document_gates(e, S.pages_of(e), 0.0018, 500).withColumn("scannedness", F.round("scannedness", 9))


@query("page_splice", f"""{WITH} SELECT doc_id, page_no, elem_idx, CASE WHEN doc_id % 3 = 0 AND page_no = 1 THEN md5(text) ELSE text END AS text FROM elements""")
def page_splice(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d)
    return P.splice(e, e.where("doc_id % 3 = 0 AND page_no = 1").withColumn("text", F.md5(F.col("text").cast("binary")))).select("doc_id", "page_no", "elem_idx", "text")


@query("page_areas_shifted", f"""{ORDERS} SELECT DISTINCT doc_id, "row", (10 * "row" + 100 * (doc_id % 3))::DOUBLE AS y FROM elements""")
def page_areas_shifted(spark: SparkSession, d: str) -> DataFrame:
    areas = _grid(spark, d, "orders").select("doc_id", "row").distinct().withColumn("areas", F.array(F.struct((10.0 * F.col("row")).alias("y"), F.lit("colour").alias("tag"))))
    moved = areas.select("doc_id", "row", F.explode(P.shift_areas(F.col("areas"), 100.0 * (F.col("doc_id") % 3))).alias("a"))
    return moved.select("doc_id", "row", "a.y")


@query("text_over_line", f"""{PARTS}, n AS (SELECT doc_id, max("row") AS last FROM elements GROUP BY doc_id), r AS (SELECT doc_id, k, {G.TOP - 2} + {G.ROW} * k AS y, {G.LEFT - 4} + {G.PITCH} * (k % 5) AS x FROM (SELECT doc_id, unnest(range(last + 2)) AS k FROM n)),
t AS (SELECT r.doc_id, r.y, r.x, e.elem_idx, e."left", e.width, dense_rank() OVER (PARTITION BY r.doc_id, r.y, r.x ORDER BY e.top DESC) AS b FROM r JOIN elements e ON e.doc_id = r.doc_id AND e.top < r.y AND e.top > r.y - 1000)
SELECT doc_id, y::DOUBLE AS line_top, min(elem_idx) AS elem_idx, x::DOUBLE AS align_left, (x + {G.PITCH})::DOUBLE AS align_right FROM t WHERE b = 1 AND "left" >= x AND "left" + width <= x + {G.PITCH} GROUP BY ALL HAVING count(*) = 1""")
def text_over_line(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d, "part")
    k = ((F.col("top") - (G.TOP - 2)) / G.ROW).cast("int")
    short = G.rules(c, 5).where("kind = 'hline'").withColumn("page_no", F.lit(0)).withColumns({"left": (F.lit(G.LEFT - 4) + G.PITCH * (k % 5)).cast("double"), "stretch": F.lit(float(G.PITCH))})
    return N.text_over_line(G.place(c, 5), short).select("doc_id", "line_top", "elem_idx", "align_left", "align_right")


@query("kind_traits", f"""{PICTURED} SELECT doc_id, elem_idx, true AS is_inline, kind = 'text' AS has_text, false AS is_delimiter, true AS is_terminal FROM pictured""")
def kind_traits(spark: SparkSession, d: str) -> DataFrame:
    return O.kind_traits(_pictured(spark, d)).select("doc_id", "elem_idx", "is_inline", "has_text", "is_delimiter", "is_terminal")


@query("tree_scan", f"""{PICTURED}, s AS (SELECT doc_id, elem_idx, col, kind, (SELECT min(o.elem_idx) FROM pictured o WHERE o.doc_id = p.doc_id AND o.elem_idx > p.elem_idx AND o.kind = 'image') AS stop FROM pictured p)
SELECT a.doc_id, a.elem_idx AS start_idx, b.elem_idx FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.elem_idx > a.elem_idx AND b.elem_idx < coalesce(a.stop, 1e9) WHERE a.col = 1 AND b.col IN (2, 4) AND b.kind = 'text'""")
def tree_scan(spark: SparkSession, d: str) -> DataFrame:
    return O.scan(_pictured(spark, d), F.col("col") == 1, F.col("col").isin(2, 4) & (F.col("kind") == "text"), F.col("kind") == "image")


@query("kth_position", f"""{PICTURED}, p AS (SELECT *, row_number() OVER w AS k, count(*) FILTER (WHERE col = 1) OVER w AS n FROM pictured WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY elem_idx DESC))
SELECT doc_id, page_no, coalesce(min(CASE WHEN n = 3 THEN k END), 0) AS size FROM p GROUP BY ALL""")
def kth_position(spark: SparkSession, d: str) -> DataFrame:
    return O.kth_position(_pictured(spark, d), F.col("col") == 1, 3, True).select("doc_id", "page_no", "size")


@query("interline_space", f"""{WITH} SELECT doc_id, elem_idx, (lead(top) OVER w - top - height)::DOUBLE AS below, (top - lag(top) OVER w - lag(height) OVER w)::DOUBLE AS above FROM elements WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY elem_idx)""")
def interline_space(spark: SparkSession, d: str) -> DataFrame:
    e = O.interline_space(_elements(spark, d)).withColumnRenamed("space", "below")
    return O.interline_space(e, True).select("doc_id", "elem_idx", "below", F.col("space").alias("above"))


@query("gap_middle", f"""{LINED} SELECT doc_id, elem_idx, (("left" + width + lead("left") OVER (PARTITION BY doc_id, page_no, line ORDER BY "left", elem_idx)) / 2)::DOUBLE AS split_at FROM grouped""")
def gap_middle(spark: SparkSession, d: str) -> DataFrame:
    return O.gap_middle(L.with_lines(_elements(spark, d))).select("doc_id", "elem_idx", "split_at")


@query("filled_upwards", f"""{LINES} SELECT doc_id, "row", col, last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY doc_id, col ORDER BY "row") AS above FROM cells""")
def filled_upwards(spark: SparkSession, d: str) -> DataFrame:
    return O.filled_upwards(_cells(spark, d, "lineitem")).select("doc_id", "row", "col", "above")


@query("shared_elements", f"""{ORDERS} SELECT DISTINCT a.doc_id, 'row' || a."row" AS a_name, 'col' || b.col AS b_name FROM elements a JOIN elements b ON a.doc_id = b.doc_id AND a.elem_idx = b.elem_idx WHERE a."row" % 2 = 0 AND b.col < 3""")
def shared_elements(spark: SparkSession, d: str) -> DataFrame:
    e = _grid(spark, d, "orders")
    of = lambda c, where: e.where(where).groupBy("doc_id", F.concat(F.lit(c), F.col(c).cast("string")).alias("name")).agg(F.collect_list("elem_idx").alias("ids"))
    return O.share_elements(of("row", "row % 2 = 0"), of("col", "col < 3"), ["doc_id"])


@query("segment_groups", f"""{LINED}, g AS (SELECT doc_id, elem_idx, min(elem_idx) OVER w AS first_idx, count(*) OVER w AS n FROM grouped WINDOW w AS (PARTITION BY doc_id, page_no, grp)) SELECT doc_id, elem_idx, first_idx FROM g WHERE n > 1""")
def segment_groups(spark: SparkSession, d: str) -> DataFrame:
    e = L.with_groups(L.with_lines(_elements(spark, d)))
    return O.segment_groups(e.withColumn("grp", F.struct("page_no", "grp")))


@query("hand_written_areas", f"""SELECT event_id AS doc_id, 0 AS page_no, floor(value * 100) / 100 AS "left", floor(value * 50) / 100 AS top, 30.0::DOUBLE AS width, 20.0::DOUBLE AS height FROM events WHERE event_type = 'click'""")
def hand_written_areas(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    a = e.select(F.col("event_id").alias("doc_id"), F.lit(0).alias("page_no"), F.when(F.col("event_type") == "click", "hand_written").otherwise("colour").alias("tag"), F.col("value").alias("left"), (F.col("value") / 2).alias("top"), F.lit(30.0).alias("width"), F.lit(20.0).alias("height"))
    return O.hand_written(a)


@query("tables_deleted", f"""{ORDERS}, t AS (SELECT doc_id, elem_idx, "row", col, "row" // 8 AS table_id FROM elements), k AS (SELECT DISTINCT doc_id, table_id FROM t WHERE (doc_id + table_id) % 3 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY table_id) - 1 AS new FROM k)
SELECT t.doc_id, elem_idx, new AS table_id, CASE WHEN new IS NOT NULL THEN "row" END AS t_row, CASE WHEN new IS NOT NULL THEN col END AS t_col FROM t LEFT JOIN n ON t.doc_id = n.doc_id AND t.table_id = n.table_id""")
def tables_deleted(spark: SparkSession, d: str) -> DataFrame:
    c = _grid(spark, d, "orders").select("doc_id", "elem_idx", F.floor(F.col("row") / 8).cast("int").alias("table_id"), F.col("row").alias("t_row"), F.col("col").alias("t_col"))
    return O.without_tables(c, c.where("(doc_id + table_id) % 3 = 0").select("doc_id", "table_id").distinct())


@query("curtail_valid", f"""{ORDERS} SELECT doc_id, "row" AS table_id, bool_and(col <> 3 OR "row" % 2 = 0) AS valid FROM elements WHERE "row" < 4 GROUP BY ALL""")
def curtail_valid(spark: SparkSession, d: str) -> DataFrame:
    e = _grid(spark, d, "orders")
    return O.curtail_valid(e.where("col <> 3 OR row % 2 = 0"), e.where("row < 4").withColumn("table_id", F.col("row")))


@query("tabular_noise", f"""{ORDERS} SELECT doc_id, elem_idx, regexp_full_match(text, '[A-Z]') OR regexp_full_match(text, '[0-9]+\\.[0-9]{{2}}') AS is_noise FROM elements""")
def tabular_noise(spark: SparkSession, d: str) -> DataFrame:
    return O.noise(_grid(spark, d, "orders"), ["[A-Z]", r"[0-9]+\.[0-9]{2}"]).select("doc_id", "elem_idx", "is_noise")


@query("aligned_with_columns", f"""{ORDERS}, b AS (SELECT doc_id, min("left") AS lo, max("left" + width) AS hi FROM elements WHERE "row" = 1 GROUP BY doc_id, col)
SELECT e.doc_id, e.elem_idx, coalesce(bool_or(abs(e."left" + 3 * (e."row" % 3) - lo) <= 3 OR abs(e."left" + 3 * (e."row" % 3) + e.width - hi) <= 3), false) AS aligned FROM elements e LEFT JOIN b ON b.doc_id = e.doc_id GROUP BY ALL""")
def aligned_with_columns(spark: SparkSession, d: str) -> DataFrame:
    e = _grid(spark, d, "orders").withColumn("table_id", F.lit(0))
    spans = e.where("row = 1").groupBy("doc_id", "table_id", "col").agg(F.min("left").alias("lo"), F.max(F.col("left") + F.col("width")).alias("hi")).drop("col")
    return O.aligned_with_columns(e.withColumn("left", F.col("left") + 3 * (F.col("row") % 3)), spans).select("doc_id", "elem_idx", "aligned")


@query("grid_based_rows", f"""{LINES} SELECT doc_id, "row", coalesce(bool_and(CASE WHEN text <> '' THEN "row" % 4 <> 2 OR col < 2 END), false) AS grid_based, bool_and(text = '') AS empty FROM cells GROUP BY ALL""")
def grid_based_rows(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d, "lineitem").withColumns({"border_top": (F.col("row") % 4 != 2) | (F.col("col") < 2), "border_left": F.lit(True), "border_right": F.lit(True)})
    return O.grid_based_rows(c).select("doc_id", "row", "grid_based", "empty")


@query("image_strings", """WITH g AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS seq, (l_quantity * 4)::DOUBLE AS x, substr(l_partkey::VARCHAR, 1, 1) AS ch FROM lineitem), i AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, (l_quantity * 4 - 2 - (l_suppkey % 5) * 3)::DOUBLE AS x, '-' || (l_suppkey % 5) AS text FROM lineitem WHERE l_suppkey % 2 = 0),
n AS (SELECT g.doc_id, g.line, g.seq, g.x, i.text, i.x AS ix, row_number() OVER (PARTITION BY g.doc_id, g.line, g.seq, g.x ORDER BY i.x DESC, i.text DESC) AS k, (SELECT max(o.x) FROM g o WHERE o.doc_id = g.doc_id AND o.line = g.line AND (o.x < g.x OR (o.x = g.x AND o.seq < g.seq))) AS gx FROM g JOIN i ON i.doc_id = g.doc_id AND i.line = g.line AND i.x <= g.x)
SELECT doc_id, line, seq, text FROM n WHERE k = 1 AND x - ix < 12 AND (gx IS NULL OR ix > gx)""")
def image_strings(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.lit(0).alias("line"), (F.col("l_quantity") * 4).alias("x"), F.col("l_partkey").alias("seq"), F.lit(6.0).alias("width"), F.substring(F.col("l_partkey").cast("string"), 1, 1).alias("ch"), "l_suppkey")
    images = li.where("l_suppkey % 2 = 0").select("doc_id", "page_no", "line", (F.col("x") - 2 - F.col("l_suppkey") % 5 * 3).alias("x"), F.concat(F.lit("-"), (F.col("l_suppkey") % 5).cast("string")).alias("text"))
    return O.image_strings(li, images).select("doc_id", F.col("page_no").alias("line"), "seq", "text")


@query("lines_outside_boxes", f"""{PARTS}, n AS (SELECT doc_id, max("row") AS last FROM elements GROUP BY doc_id), h AS (SELECT doc_id, 'hline' AS kind, {G.TOP - 2} + {G.ROW} * unnest(range(last + 2)) AS top, {G.LEFT - 4} AS "left", {G.PITCH * 5} AS stretch FROM n),
v AS (SELECT doc_id, 'vline' AS kind, {G.TOP - 2} AS top, {G.LEFT - 4} + {G.PITCH} * unnest(range(6)) AS "left", {G.ROW} * (last + 1) AS stretch FROM n), r AS (SELECT * FROM h UNION ALL SELECT * FROM v)
SELECT doc_id, kind, top::DOUBLE AS top, "left"::DOUBLE AS "left" FROM r WHERE NOT ("left" >= 30 AND "left" + CASE WHEN kind = 'hline' THEN stretch ELSE 0 END <= 530 AND top >= 30 AND top + CASE WHEN kind = 'vline' THEN stretch ELSE 0 END <= 150)""")
def lines_outside(spark: SparkSession, d: str) -> DataFrame:
    r = G.rules(_cells(spark, d, "part"), 5).withColumn("page_no", F.lit(0))
    boxes = r.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(30.0).alias("top"), F.lit(30.0).alias("left"), F.lit(500.0).alias("width"), F.lit(120.0).alias("height"))
    return O.lines_outside(r, boxes).select("doc_id", "kind", "top", "left")


_FORM = """WITH f AS (SELECT user_id AS doc_id, event_id AS key, CASE event_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'button' WHEN 2 THEN 'push_button' ELSE 'choice' END AS type, event_id % 30 AS y, 6 + event_id % 20 AS height, CASE WHEN event_id % 3 = 0 THEN 9.0 END AS fs, event_type FROM events),
p AS (SELECT doc_id, key, type, key % 7 AS page_no, y, height, coalesce(fs, CASE WHEN height < 14 THEN height - 2 ELSE 12 END) AS font_size, event_type FROM f WHERE type <> 'push_button' AND key % 11 <> 0)"""


@query("form_fields", f"""{_FORM} SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, y, key) - 1 AS elem_idx, event_type || ',' || type AS text, font_size::DOUBLE AS font_size, CASE WHEN type = 'button' THEN event_type = 'click' END AS checked FROM p""")
def form_fields(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.element_at(F.array(*map(F.lit, ("text", "button", "push_button", "choice"))), (F.col("event_id") % 4 + 1).cast("int"))
    fields = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("key"), kind.alias("type"), (F.col("event_id") % 30).cast("double").alias("top"), F.lit(72.0).alias("left"), F.lit(80.0).alias("width"), (6 + F.col("event_id") % 20).cast("double").alias("height"), F.when(F.col("event_id") % 3 == 0, 9.0).alias("font_size"), F.array("event_type", kind).alias("values"), F.array(F.lit("click")).alias("on"))
    notes = e.where("event_id % 11 <> 0").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("key"), (F.col("event_id") % 7).alias("page_no"))
    return O.form_elements(fields, notes).select("doc_id", "page_no", "elem_idx", "text", "font_size", "checked")


@query("ocr_phrases", f"""{WITH}, w AS (SELECT doc_id, page_no, line_no, elem_idx, unnest(regexp_extract_all(text, '[^ ]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^ ]+'), 1) AS k, top, "left" FROM elements),
x AS (SELECT *, "left" + 6 * coalesce(sum(length(word) + 1 + 5 * (length(word) % 7 = 0)::INT) OVER (PARTITION BY doc_id, page_no, elem_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, 6 * length(word) AS w, top + length(word) % 3 AS y FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, line_no ORDER BY x, elem_idx, k) AS n, lag(x + w) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY x, elem_idx, k) AS e FROM x),
p AS (SELECT *, count(*) FILTER (WHERE e IS NULL OR x - e > 12) OVER (PARTITION BY doc_id, page_no ORDER BY line_no, x, elem_idx, k) - 1 AS phrase FROM o)
SELECT doc_id, page_no, phrase, string_agg(word, ' ' ORDER BY x, elem_idx, k) AS text, min(x)::DOUBLE AS "left", round(avg(y), 6) AS top, (max(x + w) - min(x))::DOUBLE AS width, CASE WHEN count(*) FILTER (WHERE length(word) > 5) * 2 > count(*) THEN 'bold' ELSE '' END AS styles FROM p GROUP BY ALL""")
def ocr_phrases(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    # the segments are shuffled, not their words, which are many times larger
    e = glyphs.by_document(_elements(spark, d).select("doc_id", "page_no", "elem_idx", "top", "left", "text"))
    w = e.select("doc_id", "page_no", "elem_idx", "top", "left", F.posexplode(F.regexp_extract_all("text", F.lit("([^ ]+)"), F.lit(1))).alias("k", "text"))
    n = F.length("text")
    before = F.coalesce(F.sum(n + 1 + F.when(n % 7 == 0, 5).otherwise(0)).over(Window.partitionBy("doc_id", "page_no", "elem_idx").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = w.select("doc_id", "page_no", (F.col("elem_idx").cast("bigint") * 100000 + F.col("k")).alias("word_id"), "text", (F.col("left") + 6 * before).alias("left"), (F.col("top") + n % 3).alias("top"), (6.0 * n).alias("width"), F.lit(10.0).alias("height"), F.lit(10.0).alias("font_size"), F.lit(3.0).alias("space_width"), (n > 5).alias("bold"), F.lit(False).alias("italic"))
    return O.ocr_phrases(words).select("doc_id", "page_no", "phrase", "text", "left", F.round("top", 6).alias("top"), "width", F.array_join("styles", ",").alias("styles"))


@query("dark_boxes", """SELECT doc_id AS image_id, min(x) AS "left", min(y) AS top, max(x) AS "right", max(y) AS bottom FROM (SELECT l_orderkey AS doc_id, l_partkey % 100 AS x, l_suppkey % 50 AS y, l_quantity FROM lineitem) WHERE l_quantity * 5 / 255.0 < 0.5 GROUP BY ALL""")
def dark_boxes(spark: SparkSession, d: str) -> DataFrame:
    g = (F.col("l_quantity") * 5).cast("int")
    return O.dark_box(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 50).alias("y"), (g * 65536 + g * 256 + g).alias("rgb")))


@query("null_ligatures", """WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark), k AS (SELECT DISTINCT lower(word) AS word FROM w), t AS (SELECT DISTINCT word FROM w),
b AS (SELECT word, CASE WHEN contains(word, 'th') THEN replace(word, 'th', '?') WHEN contains(word, 'ti') THEN replace(word, 'ti', '?') ELSE word END AS broken FROM t),
c AS (SELECT broken, unnest(['ff', 'fi', 'ffi', 'ti', 'tt', 'th']) AS l, unnest(range(6)) AS o FROM (SELECT DISTINCT broken FROM b WHERE contains(broken, '?')))
SELECT DISTINCT b.broken, coalesce((SELECT arg_min(replace(c.broken, '?', l), o) FROM c JOIN k ON k.word = lower(replace(c.broken, '?', l)) WHERE c.broken = b.broken), b.broken) AS word FROM b""")
def null_ligatures(spark: SparkSession, d: str) -> DataFrame:
    w = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("word"))
    # the dictionary is the benchmark's own words, a bounded table
    known = w.agg(F.collect_set(F.lower("word")).alias("known"))
    has = lambda x: F.instr("word", x) > 0
    broken = F.when(has("th"), F.replace(F.col("word"), F.lit("th"), F.lit("\0"))).when(has("ti"), F.replace(F.col("word"), F.lit("ti"), F.lit("\0"))).otherwise(F.col("word"))
    b = w.select(broken.alias("b")).distinct()
    fixed = b.join(F.broadcast(known), F.lit(True)).select("b", T.fix_null_ligatures("b", F.col("known")).alias("word"))
    return fixed.select(F.replace(F.col("b"), F.lit("\0"), F.lit("?")).alias("broken"), F.replace(F.col("word"), F.lit("\0"), F.lit("?")).alias("word"))


@query("layout_metrics", f"""{WITH} SELECT count(*) AS elements_total, count(*) AS text_elements_total, count(*) FILTER (WHERE elem_idx = 0) AS documents_total, max(page_no) AS last_page FROM elements""")
def layout_metrics(spark: SparkSession, d: str) -> DataFrame:
    seen, observed = O.with_metrics(_elements(spark, d))
    seen.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([observed.get], "elements_total long, text_elements_total long, documents_total long, last_page int")
