"""Queries on grids: neighbours and table algebra over relations shown as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from ..operators import algebra as A
from ..operators import enrich as E
from ..operators import neighbours as N
from ..sources import grid as G
from .texts import Query, type_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _cells(spark: SparkSession, d: str, name: str) -> DataFrame:
    return G.cells(spark.read.parquet(f"{d}/{name}.parquet"), name)


def _elements(spark: SparkSession, d: str, name: str) -> DataFrame:
    return G.elements(spark.read.parquet(f"{d}/{name}.parquet"), name)


ORDERS, LINES, PARTS = (f"WITH {G.cells_sql(n)}" for n in ("orders", "lineitem", "part"))


@query("table_cells", f'{ORDERS} SELECT doc_id, table_id, "row", col, text FROM cells')
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, "orders")


def _shadow(direction: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = _elements(spark, d, "orders")
        s = N.shadow_vertical(e, direction == "below") if direction in ("below", "above") else N.shadow_horizontal(e, direction == "right")
        return s.select("doc_id", "elem_idx", "shadow")

    query(f"shadow_{direction}", f"{ORDERS}, {N.shadow_sql(direction)} SELECT doc_id, elem_idx, shadow FROM shadow")(run)


for _d in ("below", "above", "left", "right"):
    _shadow(_d)


def _ruled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _cells(spark, d, "part")
    return G.place(c, 5), G.rules(c, 5).withColumn("page_no", F.lit(0))


@query("visual_sides", f"""{PARTS}, last AS (SELECT doc_id, max("row") AS n FROM elements GROUP BY doc_id), ruled AS (SELECT doc_id, n, {G.LEFT - 4} + {G.PITCH} * unnest(range(6)) AS x, {G.TOP - 2} AS y, {G.TOP - 2} + {G.ROW} * (n + 1) AS y2 FROM last),
beside AS (SELECT e.doc_id, e.elem_idx, max(CASE WHEN o."left" + o.width < e."left" THEN o."left" + o.width END) AS before, min(CASE WHEN o."left" > e."left" + e.width THEN o."left" END) AS after FROM elements e LEFT JOIN elements o ON o.doc_id = e.doc_id AND o.top = e.top GROUP BY ALL)
SELECT e.doc_id, e.elem_idx, coalesce(max(CASE WHEN x < e."left" + 2 AND x > coalesce(before - 2, -1) THEN x END), CASE WHEN any_value(before) IS NULL THEN 0 ELSE (any_value(before) + any_value(e."left")) / 2 END)::DOUBLE AS vis_left,
  coalesce(min(CASE WHEN x > e."left" + e.width - 2 AND x < coalesce(after + 2, 1e9) THEN x END), CASE WHEN any_value(after) IS NULL THEN 612 ELSE (any_value(after) + any_value(e."left" + e.width)) / 2 END)::DOUBLE AS vis_right
FROM elements e JOIN ruled r ON r.doc_id = e.doc_id AND y < e.top AND y2 > e.top JOIN beside b ON b.doc_id = e.doc_id AND b.elem_idx = e.elem_idx GROUP BY e.doc_id, e.elem_idx""")
def visual_sides(spark: SparkSession, d: str) -> DataFrame:
    e, r = _ruled(spark, d)
    return N.visual_sides(e.select(*N.KEY, *N.BOX), r).select("doc_id", "elem_idx", "vis_left", "vis_right")


@query("visual_ends", f"""{PARTS}, n AS (SELECT doc_id, max("row") AS last FROM elements GROUP BY doc_id)
SELECT doc_id, elem_idx, ({G.TOP - 2} + {G.ROW} * "row")::DOUBLE AS vis_top, ({G.TOP - 2} + {G.ROW} * ("row" + 1))::DOUBLE AS vis_bottom FROM elements""")
def visual_ends(spark: SparkSession, d: str) -> DataFrame:
    e, r = _ruled(spark, d)
    return N.visual_ends(e.select(*N.KEY, *N.BOX), r).select("doc_id", "elem_idx", "vis_top", "vis_bottom")


@query("neighbours_below", f"""{ORDERS}, p AS (
  SELECT a.doc_id, a.elem_idx, c.elem_idx AS id, row_number() OVER (PARTITION BY a.doc_id, a.elem_idx ORDER BY c.top, c."left", c.elem_idx) AS k, c."left", c.width, dense_rank() OVER (PARTITION BY a.doc_id, a.elem_idx ORDER BY c.top) AS line
  FROM elements a JOIN elements c ON a.doc_id = c.doc_id AND c.top > a.top + 1 AND c.top < a.top + 1000 AND c."left" + c.width / 2 > a."left" AND c."left" + c.width / 2 < a."left" + a.width)
SELECT doc_id, elem_idx, id::VARCHAR AS ids FROM p WHERE k = 1""")
def neighbours_below(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d, "orders").withColumns({"vis_left": F.col("left"), "vis_right": F.col("left") + F.col("width")})
    return N.neighbour_lists(e, "below").select("doc_id", "elem_idx", F.array_join("ids", ",").alias("ids"))


@query("neighbours_right", f"""{ORDERS}, p AS (SELECT a.doc_id, a.elem_idx, c.elem_idx AS id, row_number() OVER (PARTITION BY a.doc_id, a.elem_idx ORDER BY c."left", c.elem_idx) AS k FROM elements a JOIN elements c ON a.doc_id = c.doc_id AND c."left" > a."left" + a.width AND c.top + c.height / 2 > a.top AND c.top + c.height / 2 < a.top + a.height)
SELECT doc_id, elem_idx, id::VARCHAR AS ids FROM p WHERE k = 1""")
def neighbours_right(spark: SparkSession, d: str) -> DataFrame:
    return N.neighbour_lists(_elements(spark, d, "orders"), "right").select("doc_id", "elem_idx", F.array_join("ids", ",").alias("ids"))


@query("underline_semi_join", f'{PARTS} SELECT doc_id, elem_idx FROM elements WHERE "left" + width / 2 <= {G.LEFT - 4 + 5 * G.PITCH}')
def underline_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return N.underlined(*_ruled(spark, d)).select("doc_id", "elem_idx")


@query("gaps_crossed_by_lines", f"""{PARTS}, g AS (SELECT doc_id, "row", elem_idx AS left_idx, lead(elem_idx) OVER w AS right_idx, "left" + width AS lo, lead("left") OVER w AS hi FROM elements WINDOW w AS (PARTITION BY doc_id, "row" ORDER BY "left", elem_idx))
SELECT doc_id, "row" AS line, left_idx, right_idx FROM g WHERE right_idx IS NOT NULL AND EXISTS (SELECT 1 FROM (SELECT unnest(range(6)) AS k) WHERE {G.LEFT - 4} + {G.PITCH} * k BETWEEN lo AND hi)""")
def gaps_crossed(spark: SparkSession, d: str) -> DataFrame:
    e, r = _ruled(spark, d)
    return N.gaps_crossed(e.withColumn("line", F.col("row")), r).select("doc_id", "line", "left_idx", "right_idx")


@query("boxed_elements", f"""{ORDERS} SELECT doc_id, elem_idx, "row" // 8 AS box_id FROM elements WHERE {G.TOP} + {G.ROW} * "row" > {G.TOP - 1} + {8 * G.ROW} * ("row" // 8) AND "left" < 300""")
def boxed_elements(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d, "orders")
    boxes = e.select("doc_id", "page_no", F.floor(F.col("row") / 8).cast("int").alias("box_id")).distinct().select("doc_id", "page_no", "box_id", (F.lit(G.TOP - 1) + 8 * G.ROW * F.col("box_id")).cast("double").alias("top"), F.lit(0.0).alias("left"), F.lit(300.0).alias("width"), F.lit(float(8 * G.ROW)).alias("height"))
    return N.within_boxes(e, boxes).select("doc_id", "elem_idx", "box_id")


@query("background_images", f"""{ORDERS}, i AS (SELECT doc_id, max("row") AS last FROM elements GROUP BY doc_id) SELECT doc_id, 1 AS elem_idx FROM i WHERE last >= 3""")
def background_images(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d, "orders")
    image = e.select("doc_id").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    # one stands on the third row, the other right of everything
    image = image.select("doc_id", F.lit(0).alias("page_no"), F.when(F.col("k") == 0, 1).otherwise(2).alias("elem_idx"), F.lit("image").alias("kind"), F.lit(float(G.TOP + 3 * G.ROW - 1)).alias("top"), F.when(F.col("k") == 0, 30.0).otherwise(590.0).alias("left"), F.lit(20.0).alias("width"), F.lit(20.0).alias("height"))
    return N.background_images(e.unionByName(image, allowMissingColumns=True)).select("doc_id", "elem_idx")


# --- algebra


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return A.mark_merged(_cells(spark, d, "lineitem"), "text = '' AND row > 1", "col = 2 AND row % 5 = 3")


MERGED = f"""{LINES}, merged AS (SELECT *, text = '' AND "row" > 1 AS v, col = 2 AND "row" % 5 = 3 AS h FROM cells)"""


@query("merged_cells", f"""{MERGED}, a AS MATERIALIZED (SELECT doc_id, "row", col, text, last_value(CASE WHEN NOT v THEN "row" END IGNORE NULLS) OVER (PARTITION BY doc_id, col ORDER BY "row") AS at_row, last_value(CASE WHEN NOT h THEN col END IGNORE NULLS) OVER (PARTITION BY doc_id, "row" ORDER BY col) AS h_col FROM merged),
b AS MATERIALIZED (SELECT a.doc_id, a."row", a.col, a.at_row, o.h_col AS at_col FROM a JOIN a o ON a.doc_id = o.doc_id AND a.at_row = o."row" AND a.col = o.col)
SELECT b.*, t.text AS merged_text FROM b JOIN a t ON t.doc_id = b.doc_id AND t."row" = b.at_row AND t.col = b.at_col""")
def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    return A.resolve_merged(_merged(spark, d)).select("doc_id", "row", "col", "at_row", "at_col", "merged_text")


@query("cell_spans", f"""{MERGED}, a AS (SELECT *, sum((NOT v)::INT) OVER (PARTITION BY doc_id, col ORDER BY "row") AS gv, sum((NOT h)::INT) OVER (PARTITION BY doc_id, "row" ORDER BY col) AS gh FROM merged),
b AS (SELECT *, count(*) OVER (PARTITION BY doc_id, col, gv) AS row_span, count(*) OVER (PARTITION BY doc_id, "row", gh) AS col_span FROM a)
SELECT doc_id, "row", col, row_span, col_span FROM b WHERE NOT v AND NOT h""")
def cell_spans(spark: SparkSession, d: str) -> DataFrame:
    return A.spans(_merged(spark, d)).select("doc_id", "row", "col", "row_span", "col_span")


@query("transpose", f'{ORDERS} SELECT doc_id, table_id, col AS "row", "row" AS col, text FROM cells')
def transpose(spark: SparkSession, d: str) -> DataFrame:
    return A.transpose(_cells(spark, d, "orders")).select("doc_id", "table_id", "row", "col", "text")


@query("row_slice", f'{ORDERS} SELECT doc_id, "row", col, text FROM cells WHERE "row" BETWEEN 2 AND 4 AND col BETWEEN 1 AND 3')
def row_slice(spark: SparkSession, d: str) -> DataFrame:
    return A.region(_cells(spark, d, "orders"), 2, 4, 1, 3).select("doc_id", "row", "col", "text")


@query("row_delete_renumber", f"""{ORDERS}, g AS (SELECT DISTINCT doc_id, "row" FROM cells WHERE col = 1 AND text = 'F'), k AS (SELECT * FROM cells c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = c.doc_id AND g."row" = c."row"))
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY "row") - 1 AS "row", col, text FROM k""")
def row_delete(spark: SparkSession, d: str) -> DataFrame:
    return A.delete_rows(_cells(spark, d, "orders"), (F.col("col") == 1) & (F.col("text") == "F")).select("doc_id", "row", "col", "text")


@query("row_merge", f"""{ORDERS}, m AS (SELECT doc_id, col, CASE WHEN "row" BETWEEN 1 AND 3 THEN 1 WHEN "row" > 3 THEN "row" - 2 ELSE "row" END AS r, text, "row" AS o FROM cells),
u AS (SELECT doc_id, r, col, text, min(o) AS o FROM m WHERE text <> '' GROUP BY ALL)
SELECT p.doc_id, p.r AS "row", p.col, coalesce(string_agg(u.text, chr(10) ORDER BY u.o), '') AS text FROM (SELECT DISTINCT doc_id, r, col FROM m) p LEFT JOIN u ON u.doc_id = p.doc_id AND u.r = p.r AND u.col = p.col GROUP BY ALL""")
def row_merge(spark: SparkSession, d: str) -> DataFrame:
    return A.merge_rows(_cells(spark, d, "orders"), 1, 3).select("doc_id", "row", "col", "text")


@query("column_boundaries", f"""{PARTS} SELECT doc_id, col, min("left") FILTER (WHERE "row" = 0)::DOUBLE AS lo, max("left" + width) FILTER (WHERE "row" = 0)::DOUBLE AS hi FROM elements GROUP BY ALL""")
def column_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return A.column_boundaries(_elements(spark, d, "part")).select("doc_id", "col", "lo", "hi")


@query("row_symmetry", f"""{LINES}, r AS (SELECT doc_id, "row", count(*) FILTER (WHERE text <> '') AS n FROM cells GROUP BY ALL), m AS (SELECT *, avg(n) OVER (PARTITION BY doc_id) AS m FROM r)
SELECT doc_id, round(1 - sum(abs(n - m)) / (count(*) * max(m)), 9) AS symmetry FROM m GROUP BY doc_id""")
def row_symmetry(spark: SparkSession, d: str) -> DataFrame:
    return A.row_symmetry(_cells(spark, d, "lineitem")).select("doc_id", F.round("symmetry", 9).alias("symmetry"))


@query("row_based_tables", f"{LINES} SELECT doc_id, count(DISTINCT CASE WHEN text <> '' THEN col END) AS n_used, count(DISTINCT CASE WHEN text <> '' THEN col END) <= 2 AS row_based FROM cells GROUP BY doc_id")
def row_based(spark: SparkSession, d: str) -> DataFrame:
    return A.row_based(_cells(spark, d, "lineitem")).select("doc_id", "n_used", "row_based")


def _borders(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("row") % 2 == 0
    return A.cell_borders(_elements(spark, d, "lineitem").withColumns({"border_top": even, "border_bottom": (F.col("row") % 4 == 1) & (F.col("col") < 3), "border_left": F.col("col") > 0, "border_right": F.lit(False)}))


BORDERS = f"""{LINES}, b AS (SELECT doc_id, "row", col, "row" % 2 = 0 AS t, "row" % 4 = 1 AND col < 3 AS u, col > 0 AS l FROM elements)"""


@query("cell_borders", f"{BORDERS} SELECT doc_id, \"row\", col, bool_or(t) AS border_top, bool_or(u) AS border_bottom, bool_or(l) AS border_left FROM b GROUP BY ALL")
def cell_borders(spark: SparkSession, d: str) -> DataFrame:
    return _borders(spark, d).select("doc_id", "row", "col", "border_top", "border_bottom", "border_left")


@query("horizontal_lines_significant", f'{BORDERS}, r AS (SELECT doc_id, "row", bool_or(t OR u) AS x FROM b GROUP BY ALL) SELECT doc_id, round(count(*) FILTER (WHERE x) / count(*), 9) AS share, count(*) FILTER (WHERE x) / count(*) >= 0.6 AS significant FROM r GROUP BY doc_id')
def lines_significant(spark: SparkSession, d: str) -> DataFrame:
    return A.lines_significant(_borders(spark, d)).select("doc_id", F.round("share", 9).alias("share"), "significant")


@query("grid_border_consistency", f"""{BORDERS}, r AS (SELECT doc_id, bool_and(n = 1) AS rows_ok FROM (SELECT doc_id, "row", count(DISTINCT (t, u)) AS n FROM b GROUP BY ALL) GROUP BY doc_id), c AS (SELECT doc_id, bool_and(n = 1) AS cols_ok FROM (SELECT doc_id, col, count(DISTINCT l) AS n FROM b GROUP BY ALL) GROUP BY doc_id)
SELECT r.doc_id, rows_ok, cols_ok FROM r JOIN c ON r.doc_id = c.doc_id""")
def grid_consistency(spark: SparkSession, d: str) -> DataFrame:
    return A.grid_consistency(_borders(spark, d)).select("doc_id", "rows_ok", "cols_ok")


HEADS = """f AS (SELECT doc_id, col, min(CASE WHEN text <> '' THEN "row" END) AS first FROM {0} GROUP BY ALL),
d AS (SELECT a.doc_id, a.first, count(DISTINCT b.col) AS have, (SELECT count(*) FROM f c WHERE c.doc_id = a.doc_id) AS cols FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.first <= a.first GROUP BY a.doc_id, a.first)"""


def _hollow(spark: SparkSession, d: str) -> DataFrame:
    """Line items whose header row lacks all but one text, so that the header goes on below."""
    return _cells(spark, d, "lineitem").withColumn("text", F.when((F.col("row") == 0) & (F.col("col") > F.col("doc_id") % 5), "").otherwise(F.col("text")))


HOLLOW = f"""{LINES}, hollow AS (SELECT doc_id, table_id, "row", col, CASE WHEN "row" = 0 AND col > doc_id % 5 THEN '' ELSE text END AS text FROM cells)"""


@query("header_depth", f"{HOLLOW}, {HEADS.format('hollow')} SELECT doc_id, min(first) + 1 AS headers FROM d WHERE have * 2 >= cols GROUP BY doc_id")
def header_depth(spark: SparkSession, d: str) -> DataFrame:
    return A.header_depth(_hollow(spark, d)).select("doc_id", "headers")


@query("header_confidence", f"""{HOLLOW}, {HEADS.format('hollow')}, hh AS (SELECT doc_id, min(first) + 1 AS headers FROM d WHERE have * 2 >= cols GROUP BY doc_id),
k AS (SELECT h.doc_id, h."row", text, {type_sql("text")} = 'NUMERIC' AS num FROM hollow h JOIN hh ON h.doc_id = hh.doc_id AND h."row" < hh.headers),
r AS (SELECT doc_id, "row", count(*) AS cols, count(*) FILTER (WHERE text <> '') AS n, count(*) FILTER (WHERE text <> '' AND num) AS num, count(*) FILTER (WHERE text <> '' AND "row" = 0) AS h FROM k GROUP BY ALL),
s AS (SELECT *, CASE WHEN n = 0 OR num / n > 0.15 THEN 0 ELSE 4 * abs(h / n - 0.5) * 0.5 * (h / n + 0.1) * (n / cols) * (1 + ln(n)) * (1 - num / n) END AS score FROM r),
w AS (SELECT *, sum((score <= 0)::INT) OVER (PARTITION BY doc_id ORDER BY "row") AS weak FROM s),
g AS (SELECT doc_id, count(*) AS headers, avg(score) AS confidence FROM w WHERE weak = 0 GROUP BY doc_id)
SELECT hh.doc_id, coalesce(g.headers, 0) AS headers, round(coalesce(g.confidence, 0), 9) AS confidence FROM hh LEFT JOIN g ON hh.doc_id = g.doc_id""")
def header_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = _hollow(spark, d)
    return A.header_confidence(c.withColumn("highlighted", F.col("row") == 0), A.header_depth(c)).select("doc_id", "headers", F.round("confidence", 9).alias("confidence"))


@query("numeric_columns", f"""{LINES}, k AS (SELECT *, {type_sql("text")} = 'NUMERIC' AS num, {type_sql("regexp_replace(text, '\\$|%|USD|EUR|€|-|_|−', '0')")} = 'NUMERIC' AS swapped FROM cells WHERE "row" > 0),
r AS (SELECT doc_id, "row" FROM k WHERE col > 0 AND num GROUP BY ALL)
SELECT k.doc_id, k.col FROM k JOIN r ON k.doc_id = r.doc_id AND k."row" = r."row" WHERE col > 0 GROUP BY ALL HAVING bool_and(text = '' OR num OR swapped)""")
def numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    return A.numeric_columns(_cells(spark, d, "lineitem")).select("doc_id", "col")


def _subtotals(spark: SparkSession, d: str) -> DataFrame:
    total = (F.col("row") > 0) & (F.col("col") == 0) & (F.pmod(F.col("row") + F.col("doc_id"), F.lit(5)) < F.when(F.col("doc_id") % 2 == 0, 1).otherwise(4))
    return _cells(spark, d, "lineitem").withColumn("text", F.when(total, F.concat(F.lit("Total of "), "text")).otherwise(F.col("text")))


@query("total_rows", f"""{LINES}, h AS (SELECT DISTINCT doc_id, "row" FROM cells WHERE "row" > 0 AND ("row" + doc_id) % 5 < CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 4 END),
i AS (SELECT *, "row" - row_number() OVER (PARTITION BY doc_id ORDER BY "row") AS g FROM h), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM i)
SELECT doc_id, "row" FROM n WHERE n <= 3""")
def total_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.total_rows(_subtotals(spark, d)).select("doc_id", "row")


@query("split_votes", f"""{PARTS}, k AS (SELECT *, {type_sql("text")} AS kind FROM cells WHERE text <> ''), l AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id, col ORDER BY "row") AS above FROM k)
SELECT doc_id, "row", count(*) FILTER (WHERE above <> kind) AS changed, round(coalesce(count(*) FILTER (WHERE above <> kind) / nullif(count(above), 0), 0), 9) AS jump FROM l GROUP BY ALL""")
def split_votes(spark: SparkSession, d: str) -> DataFrame:
    return A.split_votes(_cells(spark, d, "part")).select("doc_id", "row", "changed", F.round("jump", 9).alias("jump"))


@query("row_hierarchy", """WITH n AS (SELECT r_regionkey AS doc_id, n_nationkey AS nk, r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey),
s AS (SELECT doc_id, nk, 0 AS k, n_name AS text, 'nation' AS kind, n_name FROM n UNION ALL SELECT doc_id, nk, s_suppkey + 1, s_name, 'supplier', n_name FROM n JOIN supplier ON s_nationkey = nk),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nk, k) + 1 AS "row" FROM s),
p AS (SELECT *, max(CASE WHEN kind = 'nation' THEN "row" END) OVER (PARTITION BY doc_id ORDER BY "row") AS up FROM o)
SELECT doc_id, "row", (kind = 'supplier')::INT AS level, CASE WHEN kind = 'supplier' THEN up END AS parent, CASE WHEN kind = 'supplier' THEN n_name || '/' || text ELSE text END AS path FROM p
UNION ALL SELECT r_regionkey, 1, 0, NULL, r_name FROM region""")
def row_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    region, nation, supplier = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation", "supplier"))
    n = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations of 5 regions, whatever the scale
    tops = region.select(F.col("r_regionkey").alias("doc_id"), F.lit(-1).alias("a"), F.lit(0).cast("long").alias("b"), F.col("r_name").alias("text"), F.lit(36.0).alias("left"))
    mids = n.select(F.col("r_regionkey").alias("doc_id"), F.col("n_nationkey").alias("a"), F.lit(0).cast("long").alias("b"), F.col("n_name").alias("text"), F.lit(48.0).alias("left"))
    lows = supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("r_regionkey").alias("doc_id"), F.col("n_nationkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"), F.col("s_name").alias("text"), F.lit(60.0).alias("left"))
    rows = tops.unionByName(mids).unionByName(lows).withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("a", "b")).cast("int")).withColumn("table_id", F.lit(0))
    return A.hierarchy(rows.select("doc_id", "table_id", "row", "left", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "row", "level", "parent", "path")


@query("column_titles", f"{HOLLOW} SELECT doc_id, col, arg_max(text, \"row\") FILTER (WHERE text <> '') AS title, coalesce(string_agg(CASE WHEN text <> '' THEN text END, '/' ORDER BY \"row\"), '') AS path FROM hollow WHERE \"row\" < 2 GROUP BY ALL")
def column_titles(spark: SparkSession, d: str) -> DataFrame:
    return A.column_titles(_hollow(spark, d), 2).select("doc_id", "col", "title", "path")


@query("table_metadata", f"""{PARTS} SELECT doc_id, max("row") + 1 AS "rows", max(col) + 1 AS columns, CASE WHEN bool_or(text LIKE '%$%') THEN '$' END AS currency_symbol, CASE WHEN bool_or(text LIKE '%$%') THEN 'DOLLAR' END AS currency_name, 1 AS factor FROM cells GROUP BY doc_id""")
def table_metadata(spark: SparkSession, d: str) -> DataFrame:
    return A.metadata(_cells(spark, d, "part")).select("doc_id", "rows", "columns", "currency_symbol", "currency_name", "factor")


@query("table_text", f"""{ORDERS}, l AS (SELECT doc_id, "row", string_agg(text, chr(9) ORDER BY col) AS t FROM cells GROUP BY ALL) SELECT doc_id, string_agg(t, chr(10) ORDER BY "row") AS text FROM l GROUP BY doc_id""")
def table_text(spark: SparkSession, d: str) -> DataFrame:
    return A.table_text(_cells(spark, d, "orders")).select("doc_id", "text")


@query("table_shapes", f"""{LINES} SELECT doc_id, max("row") + 1 AS n_rows, max(col) + 1 AS n_cols, count(*) FILTER (WHERE text <> '') AS n_filled FROM cells GROUP BY doc_id""")
def table_shapes(spark: SparkSession, d: str) -> DataFrame:
    return A.shape(_cells(spark, d, "lineitem")).select("doc_id", "n_rows", "n_cols", "n_filled")


def _parts_of_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order grids cut in tables of 8 rows that each repeat the header, of which every fourth has another."""
    c = _cells(spark, d, "orders")
    body = c.where("row > 0").withColumn("table_id", F.floor((F.col("row") - 1) / 8).cast("int")).withColumn("row", ((F.col("row") - 1) % 8 + 1).cast("int"))
    head = c.where("row = 0").drop("table_id").join(body.select("doc_id", "table_id").distinct(), "doc_id").withColumn("text", F.when((F.col("table_id") == 3) & (F.col("col") == 0), "other").otherwise(F.col("text")))
    cells = body.unionByName(head.select(body.columns))
    heads = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("row") == 0, F.struct("col", "text")))), lambda x: x["text"]), "\t")
    tables = cells.groupBy("doc_id", "table_id").agg((F.max("col") + 1).alias("n_cols"), heads.alias("header"), (F.col("table_id") * 100).alias("first_idx"), (F.col("table_id") * 100 + 99).alias("last_idx"))
    return cells, tables


@query("continued_tables", f"""{ORDERS}, b AS (SELECT doc_id, ("row" - 1) // 8 AS t, "row", col, text FROM cells WHERE "row" > 0)
SELECT doc_id, CASE WHEN t = 3 THEN 3 ELSE 0 END AS table_id, CASE WHEN t = 3 THEN "row" - 24 ELSE "row" END AS "row", col, text FROM b
UNION ALL SELECT DISTINCT c.doc_id, x.t, 0, c.col, CASE WHEN x.t = 3 AND c.col = 0 THEN 'other' ELSE c.text END FROM cells c JOIN (SELECT DISTINCT doc_id, CASE WHEN t = 3 THEN 3 ELSE 0 END AS t FROM b) x ON c.doc_id = x.doc_id WHERE c."row" = 0""")
def continued_tables(spark: SparkSession, d: str) -> DataFrame:
    cells, tables = _parts_of_tables(spark, d)
    return A.merge_continued(cells, A.continued_tables(tables)).select("doc_id", "table_id", "row", "col", "text")


@query("wrapped_row_merge", f"""{PARTS}, l AS (SELECT doc_id, "row", col, CASE WHEN "row" % 3 = 2 AND col <> 1 THEN '' WHEN "row" % 3 = 2 THEN lower(text) ELSE text END AS text FROM cells), g AS (SELECT *, CASE WHEN "row" % 3 = 2 THEN "row" - 1 ELSE "row" END AS into_row FROM l),
m AS (SELECT doc_id, into_row, col, coalesce(string_agg(nullif(text, ''), chr(10) ORDER BY "row"), '') AS text FROM g GROUP BY ALL)
SELECT doc_id, 0 AS table_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY into_row) - 1 AS "row", col, text FROM m""")
def wrapped_row_merge(spark: SparkSession, d: str) -> DataFrame:
    lowered = _cells(spark, d, "part").withColumn("text", F.when((F.col("row") % 3 == 2) & (F.col("col") != 1), "").otherwise(F.col("text")))
    return A.merge_wrapped(lowered.withColumn("text", F.when((F.col("row") % 3 == 2) & (F.col("col") == 1), F.lower("text")).otherwise(F.col("text"))))


@query("column_reassignment", f"{PARTS} SELECT doc_id, elem_idx, col FROM elements")
def column_reassignment(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d, "part")
    b = e.select("doc_id", F.lit(0).alias("table_id"), "col").distinct().select("doc_id", "table_id", "col", (F.lit(G.LEFT) + G.PITCH * F.col("col")).cast("double").alias("lo"), (F.lit(G.LEFT) + G.PITCH * (F.col("col") + 1)).cast("double").alias("hi"))
    return A.reassign_by_overlap(e, b).select("doc_id", "elem_idx", "col")




@query("header_votes", f"{ORDERS} SELECT DISTINCT doc_id, 1 AS headers FROM cells")
def header_votes(spark: SparkSession, d: str) -> DataFrame:
    return E.header_votes(_cells(spark, d, "orders").withColumn("highlighted", F.col("row") == 0)).select("doc_id", "headers")


def _stacked(spark: SparkSession, d: str) -> DataFrame:
    """Order grids in which every ninth row is a header again."""
    c = _cells(spark, d, "orders")
    names = F.array(*[F.lit(n) for n, _, _ in G.GRIDS["orders"][2]])
    return c.withColumn("text", F.when(F.col("row") % 9 == 0, names[F.col("col")]).otherwise(F.col("text")))


@query("split_tables", f"""{ORDERS}, n AS (SELECT * FROM (SELECT DISTINCT col, text AS name FROM cells WHERE "row" = 0))
SELECT doc_id, "row" // 9 AS part, "row" % 9 AS "row", c.col, CASE WHEN "row" % 9 = 0 THEN name ELSE text END AS text FROM cells c JOIN n ON c.col = n.col""")
def split_tables(spark: SparkSession, d: str) -> DataFrame:
    return E.split_tables(_stacked(spark, d)).select("doc_id", "part", "row", "col", "text")


@query("table_captions", f"{ORDERS} SELECT DISTINCT doc_id, 'Orders of ' || doc_id AS caption FROM cells")
def table_captions(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d, "orders")
    title = e.select("doc_id").distinct().select("doc_id", F.lit(-1).alias("elem_idx"), F.lit(0).alias("page_no"), F.lit("text").alias("kind"), F.lit(20.0).alias("top"), F.lit(100.0).alias("left"), F.lit(90.0).alias("width"), F.lit(10.0).alias("height"), F.concat(F.lit("Orders of "), F.col("doc_id").cast("string")).alias("text"))
    return E.captions(e.unionByName(title, allowMissingColumns=True), e.select("doc_id", F.lit(0).alias("table_id"), "elem_idx")).select("doc_id", "caption")


@query("column_splitting", f"{PARTS} SELECT doc_id, elem_idx, col FROM elements")
def column_splitting(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d, "part")
    # two columns read as one, whose header holds two texts
    joined = e.withColumn("col", F.when(F.col("col") >= 2, F.col("col") - 1).otherwise(F.col("col"))).withColumn("width", F.least("width", F.lit(float(G.PITCH - 6))))
    return E.part_header_cells(joined).select("doc_id", "elem_idx", F.col("col"))
