"""Queries that run whole documents: layout, partitions, rectangles, JSON and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, partition, rectangles
from ..sinks import html, visual_json
from ..sources import grid as G
from .grids import PARTS
from ..operators import lines as L
from .texts import LINED, WITH, Query, _elements, any_number_sql, mask_sql, page_number_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return G.elements(spark.read.parquet(f"{d}/orders.parquet"), "orders")


@query("document_layout")
def document_layout(spark: SparkSession, d: str) -> DataFrame:
    columns = ["shadow_above", "shadow_below", "shadow_left", "shadow_right", "vis_left", "vis_right", "vg_id", "table_id", "t_row", "t_col"]
    return layout.document_layout(_orders(spark, d), columns=columns).select("doc_id", "elem_idx", *[F.round(c, 6).alias(c) if c.startswith("vis") else c for c in columns])


@query("text_document_layout")
def text_document_layout(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import pages
    from ..sources import text_layout

    e = _elements(spark, d)
    merged = pages.merge_pages(e, text_layout.pages_of(e))[0]
    return layout.document_layout(merged, columns=["vg_id", "table_id"]).groupBy("doc_id").agg(F.count_distinct("vg_id").alias("paragraphs"), F.count_distinct("table_id").alias("tables"), F.count("*").alias("elements"))


@query("detect_tables", f"WITH {G.cells_sql('orders')}" + ' SELECT doc_id, 0 AS table_id, "row", col, text FROM cells WHERE doc_id IN (SELECT doc_id FROM cells GROUP BY doc_id HAVING max("row") > 0)')
def detect_tables(spark: SparkSession, d: str) -> DataFrame:
    e = _orders(spark, d)
    return layout.cells_of(e, layout.document_layout(e, columns=["table_id", "t_row", "t_col"])).select("doc_id", "table_id", "row", "col", "text")


def _side_sql(foot: bool) -> str:
    """Size of the header or footer of each page of the texts' layout, as the table ``head`` or ``foot``."""
    s, way = ("foot", "DESC") if foot else ("head", "")
    end = "top" if foot else "top + height"
    out = "e_end < greatest(p_end - 79.2, 673.2)" if foot else "e_end > least(p_end + 79.2, 118.8)"
    ils = "p_top - top - height" if foot else "top - p_top - p_height"
    far = "p_top > 712.8" if foot else "p_top < 79.2"
    numbers = "OR nn = 1" if foot else ""
    w = "PARTITION BY doc_id, page_no ORDER BY k"
    return f"""
{s}_o AS (SELECT doc_id, page_no, elem_idx, top, height, "left", width, text, {end} AS e_end, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY elem_idx {way}) AS k FROM elements),
{s}_p AS (SELECT *, lag(e_end, 1, {0 if foot else 792}) OVER ({w}) AS p_end, lag(top) OVER ({w}) AS p_top, lag(height) OVER ({w}) AS p_height FROM {s}_o),
{s}_n AS (SELECT *, p_top IS NOT NULL AND NOT {L.same_line_sql("p_top", "p_height", "top", "height")} AS turn FROM {s}_p),
{s}_l AS (SELECT *, sum(turn::INT) OVER ({w}) AS line, regexp_full_match(text, '[!-/:-@\[-`{{-~]') AS sign FROM {s}_n),
{s}_c AS (SELECT *, NOT turn AND (count(*) FILTER (WHERE NOT sign) OVER (PARTITION BY doc_id, page_no, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) = 3 AS full_line, {out} AS out, {ils} AS ils, min(k) OVER (PARTITION BY doc_id, page_no, line) AS line_start FROM {s}_l),
{s}_stop AS (SELECT doc_id, page_no, count(*) AS total, min(CASE WHEN full_line OR out THEN k END) AS stop FROM {s}_c GROUP BY ALL),
{s}_end AS (SELECT s.*, coalesce(c.full_line, false) AS by_line, CASE WHEN c.full_line THEN c.line_start - 1 ELSE coalesce(stop - 1, total) END AS n0, c.{"top" if foot else "top"} AS b_top, c.height AS b_height FROM {s}_stop s LEFT JOIN {s}_c c ON c.doc_id = s.doc_id AND c.page_no = s.page_no AND c.k = s.stop),
{s}_in AS (SELECT c.*, e.n0, e.stop, e.by_line FROM {s}_c c JOIN {s}_end e ON c.doc_id = e.doc_id AND c.page_no = e.page_no WHERE k <= coalesce(stop - by_line::INT, total)),
{s}_al AS (SELECT doc_id, page_no, line, arg_min("left", k) AS a, 612 - arg_max("left" + width, k) AS b, count(*) FILTER (WHERE {any_number_sql("text")}) AS nn FROM {s}_in WHERE k < coalesce(stop, 1000000) GROUP BY ALL),
{s}_as AS (SELECT *, CASE WHEN a < 45 THEN 1 WHEN b < 45 THEN 2 WHEN a > 2 * b THEN 3 WHEN a > 150 AND b > 150 AND abs(b / a - 1) < 0.1 THEN 4 ELSE 5 END AS al FROM {s}_al),
{s}_tu AS (SELECT i.doc_id, i.page_no, i.k, i.ils, i.ils >= 2 * i.height AS apart, i.line = 1 AND {far} AS edge, i.line > 1 AND NOT i.ils >= 2 * i.height AND (x.al <> y.al {numbers.replace("nn", "x.nn")}) AS changed, l.line_start AS before
  FROM {s}_in i JOIN (SELECT DISTINCT doc_id, page_no, line, line_start FROM {s}_in) l ON l.doc_id = i.doc_id AND l.page_no = i.page_no AND l.line = i.line - 1 LEFT JOIN {s}_as x ON x.doc_id = i.doc_id AND x.page_no = i.page_no AND x.line = i.line - 2 LEFT JOIN {s}_as y ON y.doc_id = i.doc_id AND y.page_no = i.page_no AND y.line = i.line - 1 WHERE i.turn),
{s}_ev AS (SELECT doc_id, page_no, k, 0 AS o, k - 1 AS size FROM {s}_tu WHERE apart UNION ALL SELECT doc_id, page_no, k, 1, k - 1 FROM {s}_tu WHERE edge UNION ALL SELECT doc_id, page_no, k, 1, before - 1 FROM {s}_tu WHERE changed),
{s}_sz AS (SELECT doc_id, page_no, list(size ORDER BY k, o) AS sizes FROM {s}_ev GROUP BY ALL),
{s}_gp AS (SELECT doc_id, page_no, arg_max(ils, k) AS gap, bool_or(edge) AS edge FROM {s}_tu GROUP BY ALL),
{s}_r AS (SELECT e.*, coalesce(sizes, []) AS sizes, coalesce(g.edge, false) AS edge, coalesce(gap, 2147483647) AS gap, {"c.top - e.b_top - e.b_height" if foot else "e.b_top - c.top - c.height"} AS last_gap FROM {s}_end e LEFT JOIN {s}_sz z ON z.doc_id = e.doc_id AND z.page_no = e.page_no LEFT JOIN {s}_gp g ON g.doc_id = e.doc_id AND g.page_no = e.page_no
  LEFT JOIN {s}_c c ON c.doc_id = e.doc_id AND c.page_no = e.page_no AND c.k = e.n0),
{s}_cut AS (SELECT *, n0 > 0 AND stop IS NOT NULL AND NOT by_line AND gap <> 0 AND coalesce(last_gap < 2 * b_height AND abs(last_gap - gap) / gap < 0.2, false) AS goes_on FROM {s}_r),
{s}_fin AS (SELECT doc_id, page_no, edge, n0, CASE WHEN goes_on THEN coalesce(sizes[-1], 0) ELSE n0 END AS n1, CASE WHEN goes_on THEN sizes[:-2] ELSE sizes END || [CASE WHEN goes_on THEN coalesce(sizes[-1], 0) ELSE n0 END] AS sizes FROM {s}_cut),
{s}_pn AS (SELECT i.doc_id, i.page_no, min(k) AS pos FROM {s}_in i WHERE k <= n0 AND {page_number_sql("text") if foot else "false"} GROUP BY ALL),
{s}_nt AS (SELECT i.doc_id, i.page_no, i.k FROM {s}_in i WHERE {"regexp_full_match(text, '(?i)continues on next page')" if foot else "false"}),
{s}_big AS (SELECT f.*, pos, list_filter(generate_series(CASE WHEN edge THEN 3 ELSE 2 END, len(sizes)), lambda i: sizes[i] - sizes[i - 1] > 2)[1] AS big FROM {s}_fin f LEFT JOIN {s}_pn p ON p.doc_id = f.doc_id AND p.page_no = f.page_no),
{s}_m AS (SELECT b.doc_id, b.page_no, least(n1, CASE WHEN big IS NULL THEN n1 ELSE greatest(coalesce(pos, 0), coalesce((SELECT min(k) FROM {s}_nt t WHERE t.doc_id = b.doc_id AND t.page_no = b.page_no AND t.k <= b.n1), 0), sizes[big - 1]) END) AS n FROM {s}_big b),
{s}_w AS (SELECT c.doc_id, c.page_no, c.k, c.line, c.top, c.height, c."left", c.text, elem_idx, n, {mask_sql("text")} AS m, dense_rank() OVER (PARTITION BY c.doc_id ORDER BY c.page_no) AS p FROM {s}_c c JOIN {s}_m m ON m.doc_id = c.doc_id AND m.page_no = c.page_no WHERE c.k <= greatest(n, 1)),
{s}_sim AS (SELECT a.doc_id, a.p, a.k, list(b.k ORDER BY b.k) AS js FROM {s}_w a JOIN {s}_w b ON a.doc_id = b.doc_id AND b.p = a.p + 1 AND a.m = b.m AND a.k <= a.n AND b.k <= b.n AND abs(a."left" - b."left") < 30 AND abs(a.top - b.top) < 30 AND abs(a.height - b.height) < 2 GROUP BY ALL),
{s}_g AS (SELECT doc_id, p, 0::BIGINT AS i, []::BIGINT[] AS used FROM (SELECT DISTINCT doc_id, p FROM {s}_w) UNION ALL
  SELECT g.doc_id, g.p, g.i + 1, list_append(g.used, list_filter(s.js, lambda x: NOT list_contains(g.used, x))[1]) FROM {s}_g g JOIN {s}_sim s ON s.doc_id = g.doc_id AND s.p = g.p AND s.k = g.i + 1 WHERE len(list_filter(s.js, lambda x: NOT list_contains(g.used, x))) > 0),
{s}_hit AS (SELECT doc_id, p, list_sort(arg_max(used, i)) AS u FROM {s}_g GROUP BY ALL),
{s}_run AS (SELECT h.doc_id, h.p, len(list_filter(generate_series(1, len(u)), lambda t: u[t] - t = u[1] - 1)) AS n FROM {s}_hit h),
{s}_sh AS (SELECT r.doc_id, r.p, CASE WHEN r.n = 0 OR r.n >= any_value(w.n) OR NOT bool_or(w.k = r.n + 1 AND NOT w.first) THEN r.n ELSE max(CASE WHEN w.k <= r.n + 1 AND w.first THEN w.k END) - 1 END AS shared
  FROM {s}_run r JOIN (SELECT *, k = min(k) OVER (PARTITION BY doc_id, p, line) AS first FROM {s}_w) w ON w.doc_id = r.doc_id AND w.p = r.p GROUP BY r.doc_id, r.p, r.n),
{s}_d AS (SELECT *, max(p) OVER (PARTITION BY doc_id) AS last, lag(shared) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM {s}_sh),
{s}_f AS (SELECT *, p < last AND coalesce(prev > shared, false) AS drops, sum((NOT (p < last AND coalesce(prev > shared, false)))::INT) OVER (PARTITION BY doc_id ORDER BY p) AS spell FROM {s}_d),
{s}_q AS (SELECT *, drops AND row_number() OVER (PARTITION BY doc_id, spell ORDER BY p) % 2 = 0 AS fresh_next FROM {s}_f),
{s}_z AS (SELECT *, coalesce(lag(fresh_next) OVER (PARTITION BY doc_id ORDER BY p), p = 1) AS fresh FROM {s}_q),
{s}_y AS (SELECT z.doc_id, z.p, last, greatest(CASE WHEN p = last THEN coalesce(prev, 0) ELSE greatest(shared, CASE WHEN fresh THEN 0 ELSE coalesce(prev, 0) END) END, coalesce((SELECT min(w.k) FROM {s}_w w JOIN {s}_nt t ON t.doc_id = w.doc_id AND t.page_no = w.page_no AND t.k = w.k WHERE w.doc_id = z.doc_id AND w.p = z.p AND w.k <= w.n), 0)) AS n FROM {s}_z z),
{s}_t AS (SELECT w.doc_id, w.p, w.line, y.n, count(*) AS size, bool_and(EXISTS (SELECT 1 FROM {s}_c c WHERE c.doc_id = w.doc_id AND c.page_no = w.page_no AND c.k > y.n AND c.text = w.text AND abs(c."left" - w."left") < 30 AND abs(c.height - w.height) < 2)) AS again FROM {s}_w w JOIN {s}_y y ON y.doc_id = w.doc_id AND y.p = w.p AND w.k <= y.n AND last > 1 GROUP BY ALL),
{s}_v AS (SELECT doc_id, p, any_value(n) AS n, sum(size) AS held, max(CASE WHEN size < 2 OR NOT again THEN line END) AS stop FROM {s}_t GROUP BY ALL),
{s} AS (SELECT w.doc_id, w.page_no, w.elem_idx FROM {s}_w w JOIN {s}_v v ON v.doc_id = w.doc_id AND v.p = w.p
  WHERE w.k <= v.n - coalesce((SELECT sum(size) FROM {s}_t t WHERE t.doc_id = v.doc_id AND t.p = v.p AND t.line > coalesce(v.stop, -1)), 0))"""


@query("page_partitions", f"""{WITH.replace("WITH", "WITH RECURSIVE", 1)},{_side_sql(False)},{_side_sql(True)}
SELECT e.doc_id, e.page_no, e.elem_idx, CASE WHEN h.elem_idx IS NOT NULL THEN 'HEADER' WHEN f.elem_idx IS NOT NULL THEN 'FOOTER' ELSE 'CONTENT' END AS partition FROM elements e
LEFT JOIN head h ON h.doc_id = e.doc_id AND h.page_no = e.page_no AND h.elem_idx = e.elem_idx LEFT JOIN foot f ON f.doc_id = e.doc_id AND f.page_no = e.page_no AND f.elem_idx = e.elem_idx""")
def page_partitions(spark: SparkSession, d: str) -> DataFrame:
    return partition.partitions(_elements(spark, d)).select("doc_id", "page_no", "elem_idx", "partition")


@query("partition_bounds", f"""{WITH.replace("WITH", "WITH RECURSIVE", 1)},{_side_sql(False)},{_side_sql(True)},
h AS (SELECT e.doc_id, e.page_no, arg_max(top + height, elem_idx) + 2 AS y FROM elements e SEMI JOIN head USING (doc_id, page_no, elem_idx) GROUP BY ALL), f AS (SELECT e.doc_id, e.page_no, arg_min(top, elem_idx) - 2 AS y FROM elements e SEMI JOIN foot USING (doc_id, page_no, elem_idx) GROUP BY ALL),
c AS (SELECT DISTINCT e.doc_id, e.page_no FROM elements e ANTI JOIN head USING (doc_id, page_no, elem_idx) ANTI JOIN foot USING (doc_id, page_no, elem_idx))
SELECT doc_id, page_no, 'HEADER' AS partition, 0.0::DOUBLE AS top, y::DOUBLE AS bottom FROM h UNION ALL SELECT doc_id, page_no, 'FOOTER', y, 792 FROM f
UNION ALL SELECT c.doc_id, c.page_no, 'CONTENT', coalesce(h.y, 0), coalesce(f.y, 792) FROM c LEFT JOIN h ON h.doc_id = c.doc_id AND h.page_no = c.page_no LEFT JOIN f ON f.doc_id = c.doc_id AND f.page_no = c.page_no""")
def partition_bounds(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d)
    return partition.bounds(e, partition.partitions(e)).select("doc_id", F.col("first_page").alias("page_no"), "partition", "top", "bottom")


@query("rectangles", f"""{PARTS}, n AS (SELECT doc_id, max("row") AS last FROM cells GROUP BY doc_id)
SELECT doc_id, ({G.TOP - 2} + {G.ROW} * r)::DOUBLE AS top, ({G.LEFT - 4} + {G.PITCH} * c)::DOUBLE AS "left", {G.PITCH}::DOUBLE AS width, {G.ROW}::DOUBLE AS height, last + 1 AS n_rows, 5 AS n_cols
FROM (SELECT *, unnest(range(last + 1)) AS r FROM n), (SELECT unnest(range(5)) AS c)""")
def rects(spark: SparkSession, d: str) -> DataFrame:
    c = G.cells(spark.read.parquet(f"{d}/part.parquet"), "part")
    return rectangles.rectangles(G.rules(c, 5).withColumn("page_no", F.lit(0))).select("doc_id", "top", "left", "width", "height", "n_rows", "n_cols")


_PT = lambda c: f"({c})::DOUBLE::VARCHAR"
_BOLD = "(regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[a-z]'))"
_SEGMENT = f"""'{{"box":{{"b":' || {_PT("top + height")} || ',"l":' || {_PT('"left"')} || ',"r":' || {_PT('"left" + width')} || ',"t":' || {_PT("top")} || '}},"color":"#000000","fontFamily":"Courier","fontSize":10.0,"id":"' || elem_idx || '_0","styles":' || CASE WHEN {_BOLD} THEN '["bold"]' ELSE '[]' END || ',"text":' || to_json(text)::VARCHAR || '}}'"""


@query("visual_json_phrases", f"""{LINED}, s AS (SELECT doc_id, page_no, grp, line, min(elem_idx) AS k, '{{"segments":[' || string_agg({_SEGMENT}, ',' ORDER BY elem_idx) || ']}}' AS j FROM grouped GROUP BY ALL),
g AS (SELECT doc_id, page_no, grp, min(k) AS k, '{{"lines":[' || string_agg(j, ',' ORDER BY k) || ']}}' AS j FROM s GROUP BY ALL),
p AS (SELECT doc_id, page_no, '{{"footerGroups":[],"groups":[' || string_agg(j, ',' ORDER BY k) || '],"headerGroups":[],"page":' || page_no || '}}' AS j FROM g GROUP BY doc_id, page_no)
SELECT doc_id, '{{"pages":[' || string_agg(j, ',' ORDER BY page_no) || ']}}' AS json FROM p GROUP BY doc_id""")
def visual_json_phrases(spark: SparkSession, d: str) -> DataFrame:
    return visual_json.phrases(_elements(spark, d))


@query("visual_json_tables", f"""{PARTS}, c AS (SELECT doc_id, "row", '{{"cells":[' || string_agg('{{"position":{{"col":' || col || ',"row":' || "row" || '}},"span":{{"columns":1,"rows":1}},"text":' || to_json(text)::VARCHAR || '}}', ',' ORDER BY col) || ']}}' AS j FROM cells GROUP BY ALL),
d AS (SELECT doc_id, string_agg(j, ',' ORDER BY "row") AS j, max("row") + 1 AS n FROM c GROUP BY doc_id), t AS (SELECT doc_id, string_agg('{{"index":' || col || ',"path":"' || text || '","title":"' || text || '"}}', ',' ORDER BY col) AS j FROM cells WHERE "row" = 0 GROUP BY doc_id)
SELECT d.doc_id, 0 AS table_id, '{{"columns":[' || t.j || '],"data":[' || d.j || '],"id":0,"metadata":{{"columnHeaderCount":1,"columns":5,"currencyName":"DOLLAR","currencySymbol":"$","multiplicativeFactor":1,"rows":' || n || '}}}}' AS json FROM d JOIN t ON t.doc_id = d.doc_id""")
def visual_json_tables(spark: SparkSession, d: str) -> DataFrame:
    return visual_json.tables(G.cells(spark.read.parquet(f"{d}/part.parquet"), "part"))


_E = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"


@query("html_render", f"""{WITH}, n AS (SELECT doc_id, page_no, string_agg('<div style="position:absolute;left:' || "left" || 'pt;top:' || top || 'pt;font-family:Courier;font-size:10pt;' || CASE WHEN {_BOLD} THEN 'font-weight:bold;' ELSE '' END || '">' || {_E} || '</div>', '' ORDER BY elem_idx) AS h FROM elements GROUP BY ALL)
SELECT doc_id, '<html><body>' || string_agg('<div class="page" style="position:relative">' || h || '</div>', '' ORDER BY page_no) || '</body></html>' AS html FROM n GROUP BY doc_id""")
def html_render(spark: SparkSession, d: str) -> DataFrame:
    return html.render(_elements(spark, d))



@query("table_html", f"""WITH {G.cells_sql("orders")}, r AS (SELECT doc_id, "row", '<tr>' || string_agg(CASE WHEN "row" = 0 THEN '<th>' || {_E} || '</th>' ELSE '<td>' || {_E} || '</td>' END, '' ORDER BY col) || '</tr>' AS h FROM cells GROUP BY ALL)
SELECT doc_id, '<table>' || string_agg(h, '' ORDER BY "row") || '</table>' AS html FROM r GROUP BY doc_id""")
def table_html(spark: SparkSession, d: str) -> DataFrame:
    return html.table_html(G.cells(spark.read.parquet(f"{d}/orders.parquet"), "orders")).select("doc_id", "html")


