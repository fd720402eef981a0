"""Queries of table splitting, column merging and total rows, over line items as tables that hold a second table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import tables as O
from ..sources import grid as G
from .texts import Query, type_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HEADS = [n for n, _, _ in G.GRIDS["lineitem"][2]]


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _styled(spark: SparkSession, d: str) -> DataFrame:
    """Line items with a second header, bold and coloured rows, heights, borders and words of totals."""
    c = G.cells(spark.read.parquet(f"{d}/lineitem.parquet"), "lineitem")
    r, k, doc = F.col("row"), F.col("col"), F.col("doc_id")
    again = r == 5 + doc % 4
    text = F.when(again, F.element_at(F.array(*map(F.lit, HEADS)), k + 1)).when((k == 0) & (r > 0) & ((r * 3 + doc) % 11 == 0), "Total").otherwise(F.col("text"))
    c = c.withColumn("text", text).withColumns({
        "styles": F.when((r == 0) | again | ((r + doc) % 7 == 4), F.array(F.lit("bold"))).otherwise(F.array().cast("array<string>")), "rgb": F.when(again & (doc % 3 == 0), 255).otherwise(0), "height": F.when(r % 6 == 2, 14.0).otherwise(10.0),
        "border_top": r % 5 == 3,
    })
    w = Window.partitionBy("doc_id", "table_id", "col").orderBy("row")
    return c.withColumns({"above_text": F.lag("text").over(w), "below_text": F.lead("text").over(w), "width": (F.length("text") * G.CHAR).cast("double")})


_HEADS = "[" + ", ".join(f"'{h}'" for h in HEADS) + "]"
STYLED = f"""WITH {G.cells_sql("lineitem")}, worded AS (SELECT doc_id, "row", col, CASE WHEN "row" = 5 + doc_id % 4 THEN {_HEADS}[col + 1] WHEN col = 0 AND "row" > 0 AND ("row" * 3 + doc_id) % 11 = 0 THEN 'Total' ELSE text END AS text,
  "row" = 0 OR "row" = 5 + doc_id % 4 OR ("row" + doc_id) % 7 = 4 AS bold, CASE WHEN "row" = 5 + doc_id % 4 AND doc_id % 3 = 0 THEN 255 ELSE 0 END AS rgb, CASE WHEN "row" % 6 = 2 THEN 14.0 ELSE 10.0 END AS height, "row" % 5 = 3 AS ruled FROM cells),
styled AS (SELECT *, text <> '' AS filled, CASE WHEN text <> '' THEN {type_sql("trim(text)")} ELSE 'NON_ALPHANUMERIC' END AS kind, lag(text) OVER w AS above, lead(text) OVER w AS below FROM worded WINDOW w AS (PARTITION BY doc_id, col ORDER BY "row"))"""
VOTES = f"""{STYLED}, looks AS (SELECT *, filled AND bold AS s, CASE WHEN filled AND rgb <> 0 THEN rgb END AS paint, CASE WHEN filled THEN height ELSE 0 END AS h FROM styled),
prior AS (SELECT *, lag(h, 1, 0) OVER d AS h0, coalesce(lag(s) OVER d, false) AS s0, coalesce(lag(kind) OVER d, 'NON_ALPHANUMERIC') AS k0, lag(paint) OVER o AS paint0, coalesce(lag(filled) OVER o, false) AS f0 FROM looks WINDOW d AS (PARTITION BY doc_id, col ORDER BY "row"), o AS (PARTITION BY doc_id ORDER BY col, "row")),
moved AS (SELECT *, CASE WHEN h0 = 0 THEN CASE WHEN h > 0 THEN 1e9 END ELSE h / h0 - 1 END AS change FROM prior),
fonted AS (SELECT *, coalesce(lead(filled) OVER d AND lead(change) OVER d < -0.15 AND change > 0.15, false) AS drops FROM moved WINDOW d AS (PARTITION BY doc_id, col ORDER BY "row")),
votes AS (SELECT doc_id, "row", count(*) FILTER (WHERE filled) AS filled, count(*) FILTER (WHERE s AND NOT s0) AS style, count(*) FILTER (WHERE filled AND kind <> k0) AS regex, count(*) FILTER (WHERE paint IS NOT NULL AND paint IS DISTINCT FROM paint0) AS colour,
  count(*) FILTER (WHERE drops) AS font, count(*) FILTER (WHERE filled <> f0) AS fill, count(*) FILTER (WHERE s) AS bold FROM fonted GROUP BY ALL)"""


@query("row_votes", f"{VOTES} SELECT * FROM votes")
def row_votes(spark: SparkSession, d: str) -> DataFrame:
    return O.row_votes(_styled(spark, d)).drop("table_id")


CANDIDATES = f"""{VOTES}, product AS (SELECT v.*, (style / filled) * (regex / filled) * (bold / filled) AS p0, (colour / filled) * (bold / filled) AS p1, (fill / 5) * (regex / filled) AS p2, (fill / 5) * (style / filled) AS p3, max("row") OVER (PARTITION BY doc_id) AS last FROM votes v WHERE filled > 0),
candidates AS (SELECT * FROM product WHERE "row" >= 2 AND "row" < last AND (p0 >= 0.4 OR p1 >= 0.8 OR p2 >= 0.6 OR p3 >= 0.6))"""


@query("split_candidates", f'{CANDIDATES} SELECT doc_id, "row", round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3 FROM candidates')
def split_candidates(spark: SparkSession, d: str) -> DataFrame:
    return O.split_candidates(_styled(spark, d)).select("doc_id", "row", *[F.round(f"p{k}", 9).alias(f"p{k}") for k in range(4)])


SPLITS = f"""{CANDIDATES}, tops AS (SELECT c.doc_id, c."row", count(*) AS cols, count(*) FILTER (WHERE s.filled) AS n, count(*) FILTER (WHERE s.filled AND kind = 'NUMERIC') AS num, count(*) FILTER (WHERE s.filled AND s.bold) AS h, count(*) FILTER (WHERE s.filled AND rgb <> 0) AS cc FROM candidates c JOIN styled s ON s.doc_id = c.doc_id AND s."row" = c."row" GROUP BY ALL),
judged AS (SELECT *, CASE WHEN num / n > 0.15 THEN 0 ELSE 4 * abs(h / n - 0.5) * abs(cc / n - 0.5) * (h / n + 0.1) * (n / cols) * (1 + ln(n)) * (1 - num / n) END AS c FROM tops WHERE n > 0),
good AS (SELECT c.*, j.c AS conf, (p0 >= 0.4)::INT + (p1 >= 0.8)::INT + (p2 >= 0.6)::INT + (p3 >= 0.6)::INT AS hits, CASE WHEN p0 >= 0.4 THEN (p0 - 0.4) / 0.2135 ELSE 0 END + CASE WHEN p2 >= 0.6 THEN (p0 - 0.4) / 0.112 ELSE 0 END + CASE WHEN p3 >= 0.6 THEN (p0 - 0.4) / 0.10042 ELSE 0 END AS gain
  FROM candidates c JOIN judged j ON j.doc_id = c.doc_id AND j."row" = c."row" WHERE j.c >= 0.8),
splits AS (SELECT doc_id, min("row") AS "row", arg_min(0.5 * gain / hits + 0.5 * conf, "row") AS confidence FROM good GROUP BY doc_id)"""


@query("table_splits", f'{SPLITS} SELECT doc_id, "row", round(confidence, 6) AS confidence FROM splits')
def table_splits(spark: SparkSession, d: str) -> DataFrame:
    return O.splits(_styled(spark, d)).select("doc_id", "row", F.round("confidence", 6).alias("confidence"))


@query("tables_split_in_two", f"""{SPLITS}, parts AS (SELECT s.*, CASE WHEN s."row" >= p."row" THEN 1 ELSE 0 END AS part, CASE WHEN s."row" >= p."row" THEN s."row" - p."row" ELSE s."row" END AS r FROM styled s LEFT JOIN splits p ON p.doc_id = s.doc_id),
held AS (SELECT *, bool_or(filled) OVER (PARTITION BY doc_id, part, col) AS holds FROM parts)
SELECT doc_id, part, r AS "row", dense_rank() OVER (PARTITION BY doc_id, part ORDER BY col) - 1 AS col, text FROM held WHERE holds""")
def tables_split_in_two(spark: SparkSession, d: str) -> DataFrame:
    c = _styled(spark, d)
    return O.split_at(c, O.splits(c)).select("doc_id", "part", "row", "col", "text")


@query("narrow_columns_merged", f"""WITH {G.cells_sql("lineitem")}, flags AS (SELECT doc_id, "row", any_value(text) FILTER (WHERE col = 3) <> '' AS flag FROM cells GROUP BY ALL),
c AS (SELECT c.doc_id, c."row", c.col, CASE WHEN c."row" = 0 AND col = 3 THEN '' WHEN c."row" > 0 AND col = 2 AND flag AND c.doc_id % 2 = 0 THEN '' ELSE text END AS text FROM cells c JOIN flags f ON f.doc_id = c.doc_id AND f."row" = c."row"),
m AS (SELECT doc_id, bool_and("row" = 0 OR p = '' OR f = '') AS merges FROM (SELECT doc_id, "row", any_value(text) FILTER (WHERE col = 2) AS p, any_value(text) FILTER (WHERE col = 3) AS f FROM c GROUP BY ALL) GROUP BY doc_id)
SELECT c.doc_id, "row", CASE WHEN merges AND col > 2 THEN col - 1 ELSE col END AS col, coalesce(string_agg(nullif(text, ''), chr(9) ORDER BY c.col), '') AS text FROM c JOIN m ON m.doc_id = c.doc_id GROUP BY c.doc_id, "row", CASE WHEN merges AND col > 2 THEN col - 1 ELSE col END""")
def narrow_columns_merged(spark: SparkSession, d: str) -> DataFrame:
    c = G.cells(spark.read.parquet(f"{d}/lineitem.parquet"), "lineitem")
    flag = F.max(F.when(F.col("col") == 3, F.col("text") != "")).over(Window.partitionBy("doc_id", "table_id", "row"))
    c = c.withColumn("flag", flag).withColumn("text", F.when((F.col("row") == 0) & (F.col("col") == 3), "").when((F.col("row") > 0) & (F.col("col") == 2) & F.col("flag") & (F.col("doc_id") % 2 == 0), "").otherwise(F.col("text")))
    return O.merge_narrow_columns(c.withColumn("width", (F.length("text") * G.CHAR).cast("double"))).select("doc_id", "row", "col", "text")


def amount_sql(c: str) -> str:
    return f"({type_sql(c)} = 'NUMERIC' OR {type_sql(f'''regexp_replace({c}, '\\$|%|USD|EUR|€|-|_|−', '0')''')} = 'NUMERIC')"


@query("styled_total_rows", f"""{STYLED}, body AS (SELECT *, {amount_sql("text")} AS amount, bool_or(col > 0 AND kind = 'NUMERIC') OVER (PARTITION BY doc_id, "row") AS num, lead(text) OVER (PARTITION BY doc_id, "row" ORDER BY col) AS beside FROM styled WHERE "row" > 0 AND filled),
numeric AS (SELECT *, lower(text) = 'total' AND {amount_sql("beside")} AS said FROM body WHERE num),
refs AS (SELECT doc_id, coalesce(min(CASE WHEN plain THEN "row" END), min("row")) AS ref, count(*) AS n FROM (SELECT doc_id, "row", NOT bool_or(bold) AS plain FROM numeric GROUP BY ALL) GROUP BY doc_id),
cols AS (SELECT doc_id, col FROM numeric WHERE col > 0 GROUP BY ALL HAVING bool_and(amount)),
marks AS (SELECT x.doc_id, x."row", ref, n, bool_or(c.col IS NOT NULL AND r.doc_id IS NOT NULL AND (x.bold <> r.bold OR x.rgb <> r.rgb)) AS other, bool_or(c.col IS NOT NULL AND x.ruled AND coalesce({amount_sql("x.above")}, false) AND (x.below IS NULL OR regexp_matches(x.below, '[a-zA-Z]'))) AS ruled, bool_or(x.said) AS said
  FROM numeric x JOIN refs f ON f.doc_id = x.doc_id LEFT JOIN cols c ON c.doc_id = x.doc_id AND c.col = x.col LEFT JOIN numeric r ON r.doc_id = x.doc_id AND r.col = x.col AND r."row" = f.ref GROUP BY ALL),
counts AS (SELECT *, count(*) FILTER (WHERE other) OVER (PARTITION BY doc_id) AS n_other, count(*) FILTER (WHERE ruled) OVER (PARTITION BY doc_id) AS n_ruled FROM marks),
cands AS (SELECT *, n >= 2 AND ((other AND n_other < n) OR (ruled AND n_ruled < n)) AS cand FROM counts),
words AS (SELECT *, bool_or(cand) OVER (PARTITION BY doc_id) AS anyc, count(*) FILTER (WHERE cand) OVER (PARTITION BY doc_id) AS n_cand FROM cands),
spoken AS (SELECT *, said AND (cand OR NOT anyc) AS hit, bool_or(said AND (cand OR NOT anyc)) OVER (PARTITION BY doc_id) AS any_hit FROM words),
chosen AS (SELECT doc_id, "row", "row" - row_number() OVER (PARTITION BY doc_id ORDER BY "row") AS g FROM spoken WHERE CASE WHEN any_hit THEN hit ELSE cand AND n_cand < n END)
SELECT doc_id, "row" FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM chosen) WHERE k <= 3""")
def styled_total_rows(spark: SparkSession, d: str) -> DataFrame:
    return O.total_rows(_styled(spark, d)).select("doc_id", "row")
