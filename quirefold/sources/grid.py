"""Relations as grids of elements and cells: a header row of column names, then the rows of a group.

Columns stand ``PITCH`` points apart and rows 14; texts are left-aligned at 6 points a character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .glyphs import PORTION, by_document

PITCH, ROW, LEFT, TOP, HEIGHT, CHAR = 96, 14, 36, 36, 10, 6
#: Relation: key columns in order, rows a document, and (name, Spark expression, DuckDB expression) of the cells.
GRIDS = {
    "orders": (["o_orderkey"], 32, [
        ("order", "cast(o_orderkey AS string)", "o_orderkey::VARCHAR"), ("status", "o_orderstatus", "o_orderstatus"), ("price", "cast(cast(o_totalprice AS decimal(18,2)) AS string)", "o_totalprice::DECIMAL(18,2)::VARCHAR"),
        ("date", "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"), ("priority", "o_orderpriority", "o_orderpriority")]),
    "lineitem": (["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 4, [
        ("line", "cast(l_linenumber AS string)", "l_linenumber::VARCHAR"), ("quantity", "cast(cast(l_quantity AS decimal(18,2)) AS string)", "l_quantity::DECIMAL(18,2)::VARCHAR"),
        ("price", "cast(cast(l_extendedprice AS decimal(18,2)) AS string)", "l_extendedprice::DECIMAL(18,2)::VARCHAR"), ("flag", "nullif(l_returnflag, 'N')", "nullif(l_returnflag, 'N')"), ("ship date", "date_format(l_shipdate, 'yyyy-MM-dd')", "strftime(l_shipdate, '%Y-%m-%d')")]),
    "part": (["p_partkey"], 16, [
        ("part", "cast(p_partkey AS string)", "p_partkey::VARCHAR"), ("name", "p_name", "p_name"), ("brand", "p_brand", "p_brand"), ("size", "cast(p_size AS string)", "p_size::VARCHAR"),
        ("price", "concat('$', cast(cast(p_retailprice AS decimal(18,2)) AS string))", "'$' || p_retailprice::DECIMAL(18,2)::VARCHAR")]),
}
#: Bytes of a relation that become cells in one task, where not ``PORTION``: parts are packed to 4 to 9 bytes a row, orders to 18.
PORTIONS = {"part": PORTION // 4}


def cells(df: DataFrame, name: str) -> DataFrame:
    """(doc_id, table_id, row, col, text): cells of a relation's grids; null and empty values are empty cells.

    Documents are formed from the key, and rows counted within each, so one shuffle on the document does, in as many parts as
    the cells need: they are several times larger than the relation, and what sorts or collects them holds a part's in memory.
    """
    keys, per, columns = GRIDS[name]
    doc = F.floor(F.col(keys[0]) / per).cast("long").alias("doc_id")
    values = F.array(*[F.struct(F.lit(k).alias("col"), F.coalesce(F.expr(e), F.lit("")).alias("text")) for k, (_, e, _) in enumerate(columns)])
    rows = by_document(df.select(doc, values.alias("v"), *keys), PORTIONS.get(name, PORTION)).withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys, F.to_json("v"))).cast("int"))
    heads = F.array(*[F.struct(F.lit(k).alias("col"), F.lit(n).alias("text")) for k, (n, _, _) in enumerate(columns)])
    # the first row brings the header with it: no second pass over the relation
    both = F.when(F.col("row") == 1, F.array(F.struct(F.lit(0).alias("row"), heads.alias("v")), F.struct(F.col("row"), F.col("v")))).otherwise(F.array(F.struct(F.col("row"), F.col("v"))))
    flat = rows.select("doc_id", F.explode(both).alias("r")).select("doc_id", "r.row", F.explode("r.v").alias("c"))
    return flat.select("doc_id", F.lit(0).alias("table_id"), "row", "c.col", "c.text")


def elements(df: DataFrame, name: str) -> DataFrame:
    """Elements of the cells that are not empty."""
    return place(cells(df, name), len(GRIDS[name][2]))


def place(found: DataFrame, columns: int, left: Column | None = None) -> DataFrame:
    """Elements where a grid's cells stand."""
    at = F.lit(LEFT) + PITCH * F.col("col") if left is None else left
    return found.where("text <> ''").select(
        "doc_id", (F.col("row") * columns + F.col("col")).cast("int").alias("elem_idx"), F.lit(0).alias("page_no"), F.lit("text").alias("kind"), (F.lit(TOP) + ROW * F.col("row")).cast("double").alias("top"), at.cast("double").alias("left"),
        (F.length("text") * CHAR).cast("double").alias("width"), F.lit(float(HEIGHT)).alias("height"), F.lit(None).cast("double").alias("stretch"), "text", F.lit("Helvetica").alias("font_family"), F.lit(10.0).alias("font_size"),
        F.when(F.col("row") == 0, F.array(F.lit("bold"))).otherwise(F.array().cast("array<string>")).alias("styles"), F.lit(0).alias("rgb"), "row", "col",
    )


def rules(found: DataFrame, columns: int) -> DataFrame:
    """Ruling lines of grids: a horizontal line over every row and one below the last, verticals at the columns' sides."""
    docs = found.groupBy("doc_id").agg(F.max("row").alias("rows"))
    y = lambda k: F.lit(TOP - 2) + ROW * k
    flat = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("rows") + 1)).alias("k")).select("doc_id", F.lit("hline").alias("kind"), y(F.col("k")).cast("double").alias("top"), F.lit(float(LEFT - 4)).alias("left"), F.lit(float(PITCH * columns)).alias("stretch"))
    tall = docs.select("doc_id", "rows", F.explode(F.sequence(F.lit(0), F.lit(columns))).alias("k")).select("doc_id", F.lit("vline").alias("kind"), F.lit(float(TOP - 2)).alias("top"), (F.lit(LEFT - 4) + PITCH * F.col("k")).cast("double").alias("left"), (ROW * (F.col("rows") + 1)).cast("double").alias("stretch"))
    return flat.unionByName(tall)


def cells_sql(name: str) -> str:
    """Common table expressions ``cells`` and ``elements`` of a relation."""
    keys, per, columns = GRIDS[name]
    vals = ", ".join(f"{{'col': {k}, 'text': coalesce({e}, '')}}" for k, (_, _, e) in enumerate(columns))
    heads = ", ".join(f"{{'col': {k}, 'text': '{n}'}}" for k, (n, _, _) in enumerate(columns))
    return f"""
listed AS (SELECT {keys[0]} // {per} AS doc_id, [{vals}] AS v, {", ".join(keys)} FROM {name}),
ranked AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY {", ".join(keys)}, v::VARCHAR) AS "row" FROM listed),
lined AS (SELECT doc_id, "row", v FROM ranked UNION ALL SELECT DISTINCT doc_id, 0, [{heads}] FROM ranked),
cells AS (SELECT doc_id, 0 AS table_id, "row", unnest(v).col AS col, unnest(v).text AS text FROM lined),
elements AS (
  SELECT doc_id, "row" * {len(columns)} + col AS elem_idx, "row", col, {TOP} + {ROW} * "row" AS top, {LEFT} + {PITCH} * col AS "left", {CHAR} * length(text) AS width, {HEIGHT} AS height, text FROM cells WHERE text <> '')"""
