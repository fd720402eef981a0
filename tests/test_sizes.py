"""What keeps queries within memory and time on larger tables: no broadcast of exploded rows, bounded tables of pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.operators import neighbours
from quirefold.plans import catalog


def plan(spark, sf, name):
    return catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["shadow_below", "shadow_above", "shadow_left", "shadow_right", "neighbours_below", "neighbours_right", "visual_sides", "visual_ends"])
def test_pages_are_not_joined(spark, sf, name):
    """Elements meet within their page's group: pairs are neither broadcast nor shuffled."""
    assert "Join" not in plan(spark, sf, name)


def _random_page(n):
    r = random.Random(3)
    some = lambda *a: [None if r.random() < 0.05 else float(r.randrange(*a)) for _ in range(n)]
    return pa.table({"elem_idx": pa.array(range(n), pa.int32()), "top": pa.array(some(5000), pa.float64()), "left": pa.array(some(500), pa.float64()), "width": pa.array(some(100), pa.float64()), "height": pa.array(some(30), pa.float64())})


def test_tall_page_in_portions(monkeypatch):
    page = neighbours._Page(_random_page(700))
    page.spans = {"vis_left": page.left - 20, "vis_right": page.right + 20, "vis_top": page.top - 20, "vis_bottom": page.bottom + 20}
    ways = [lambda: neighbours._vertical(page, True), lambda: neighbours._vertical(page, False), lambda: neighbours._horizontal(page, True), lambda: neighbours._horizontal(page, False)]
    lists = [lambda d=d: neighbours._lists(page, d) for d in ("below", "above", "left", "right")]
    whole = [f() for f in ways], [f() for f in lists]
    assert all((x != neighbours.NONE).any() for x in whole[0]) and all(any(x) for x in whole[1])
    monkeypatch.setattr(neighbours, "CELLS", 500)
    assert all(np.array_equal(x, f()) for x, f in zip(whole[0], ways, strict=True)) and whole[1] == [f() for f in lists]


@pytest.mark.parametrize("name", ["glyph_filter", "font_normalised", "word_assembly", "justified_lines", "aligned_gaps"])
def test_glyphs_are_made_once_and_not_shuffled(spark, sf, name):
    """The texts are shuffled, not the glyphs that they give; fonts are found without a join."""
    p = plan(spark, sf, name)
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 1 and p.count("posexplode") == 1


def test_fonts_of_either_sign_and_none(spark):
    from quirefold.operators import glyphs

    rows = [(1, 0, 2, 5.0, "A", "Courier", 400.0, -10.0, 500.0, 5.0, 6.0), (1, 0, 1, 5.0, "b", "Courier", 400.0, 10.0, 500.0, 5.0, 6.0), (1, 0, 3, 5.0, "c", None, None, None, 0.0, 5.0, 6.0), (2, 0, 1, 5.0, "A", "Courier", 700.0, 10.0, 500.0, 5.0, 6.0)]
    g = spark.createDataFrame(rows, "doc_id bigint, page_no int, seq bigint, x double, ch string, font_name string, font_weight double, font_size double, space_per_size double, space_width double, width double")
    table = {(r.doc_id, r.font_name, s): (r.family, r.styles, r.size, r.space) for r in glyphs.font_table(g).collect() for s in r.sizes}
    each = {(r.doc_id, r.font_name, r.font_size): (r.family, r.styles, r.size, r.space) for r in glyphs.with_fonts(g).collect()}
    assert table == each and len(each) == 4 and table[1, "Courier", 10.0] == table[1, "Courier", -10.0]


@pytest.mark.parametrize("name", ["detect_tables", "page_partitions"])
def test_exploded_rows_are_not_broadcast(spark, sf, name):
    assert "BroadcastHashJoin" not in plan(spark, sf, name)


@pytest.mark.parametrize("name", ["row_hierarchy", "narrow_columns_merged", "page_partitions"])
def test_groups_pass_as_arrow(spark, sf, name):
    """Neither lists of all earlier rows nor a pandas frame a group."""
    p = plan(spark, sf, name)
    assert "collect_list" not in p and "FlatMapGroupsInPandas" not in p and "FlatMapGroupsInArrow" in p


def test_hierarchy_of_one_long_table(spark):
    """A table of 30,000 rows in one pass."""
    from pyspark.sql import functions as F

    from quirefold.operators import algebra

    rows = spark.range(30000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("table_id"), F.col("id").cast("int").alias("row"), F.when(F.col("id") % 100 == 1, 36.0).otherwise(48.0).alias("left"), F.col("id").cast("string").alias("text"))
    got = {r.row: (r.level, r.parent, r.path) for r in algebra.hierarchy(rows).where("row IN (0, 1, 2, 29902, 29999)").collect()}
    assert got == {0: (0, None, "0"), 1: (0, None, "1"), 2: (0, None, "2"), 29902: (1, 29901, "29901/29902"), 29999: (1, 29901, "29901/29999")}


@pytest.mark.parametrize("name", ["document_layout", "detect_tables"])
def test_layouts_pass_as_arrow_in_one_shuffle(spark, sf, name):
    """Documents are not pandas frames, and their elements are not shuffled anew to come together."""
    p = plan(spark, sf, name)
    assert "InPandas" not in p and "MapInArrow" in p
    assert name != "document_layout" or p.count("Exchange hashpartitioning") == 1


def test_layout_of_documents_over_many_batches(spark, sf):
    """Documents that an Arrow batch cuts, or that hold many batches, are put together; null tops count as 0."""
    from quirefold.operators import layout
    from quirefold.plans import documents

    e = documents._orders(spark, sf).where("doc_id < 4")
    odd = e.select("doc_id", "elem_idx", "kind", "left", "width", "height", "text").where("doc_id = 1 AND elem_idx < 40").withColumn("doc_id", F.lit(-1)).withColumn("top", F.when(F.col("elem_idx") % 3 == 0, F.lit(None)).otherwise(F.col("elem_idx") * 2.0))
    for elements in (e, odd):
        whole = sorted(layout.document_layout(elements).collect())
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            assert sorted(layout.document_layout(elements).collect()) == whole and len(whole) == elements.count()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    part = {(r.doc_id, r.elem_idx): (r.vg_id, r.table_id) for r in layout.document_layout(e, columns=["vg_id", "table_id"]).collect()}
    assert part == {(r.doc_id, r.elem_idx): (r.vg_id, r.table_id) for r in layout.document_layout(e).collect()}


@pytest.mark.parametrize("name", ["merged_cells", "table_splits", "split_candidates", "ocr_phrases", "table_html", "row_delete_renumber"])
def test_cells_and_words_are_shuffled_once_and_not_joined(spark, sf, name):
    """What they are made of is shuffled, in a number of parts that goes with its size."""
    p = plan(spark, sf, name)
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in p


def test_splits_are_judged_by_several_header_rows(spark):
    """The mean of a header's rows before the first weak one, as ``header_confidence`` gives it for the lower part alone."""
    from quirefold.operators import algebra, tables

    rows = [["a", "b", "c"], ["1", "2", "3"], ["d", "e", "f"], ["g", "h", "i"], ["4", "5", "6"], ["7", "8", "9"]]
    c = spark.createDataFrame([(1, 0, r, k, t, ["bold"] if t.isalpha() else [], 0, 10.0) for r, row in enumerate(rows) for k, t in enumerate(row)], "doc_id long, table_id int, row int, col int, text string, styles array<string>, rgb int, height double")
    for n in (1, 2, 3):
        below = c.where("row >= 2").withColumn("row", F.col("row") - 2).withColumns({"highlighted": F.size("styles") > 0})
        want = algebra.header_confidence(below, spark.createDataFrame([(1, 0, n)], "doc_id long, table_id int, headers int")).first().confidence
        got = {r.row: r["__c"] for r in tables._candidates(c.withColumns({"highlighted": F.size("styles") > 0, "coloured": F.lit(False)}), None, True, n).collect()}
        assert want > 0 and abs(got[2] - want) < 1e-12


def test_words_are_cut_as_texts_are_laid_out(spark, tmp_path):
    """Neither lists of a line's words nor a pass over its words so far; rows as by SQL, for signs of every kind and a text of many batches."""
    import duckdb

    r = random.Random(5)
    signs = [*"aB7.,-_$ \t\n\r\x0b\x0c\x01\x1c\x85é\xa0\xad½٣÷", *map(chr, (0x890, 0x180E, 0x2003, 0x200B, 0x2028, 0x3000, 0x3011, 0xE010, 0x13439, 0x1F600))]
    texts = [None, "", " ", "a\u0890b", "a\u3000\x85", ("a1 " * 25 + "\n") * 1200, *("".join(r.choices(signs, k=r.randrange(400))) for _ in range(300))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(catalog.SQL["words_indexed"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["words_indexed"](spark, str(tmp_path)).collect())) == want and len(want) > 60000
    p = plan(spark, str(tmp_path), "words_indexed")
    assert "aggregate(" not in p and "Generate" not in p


def test_parted_headers_are_handed_down_without_a_join(spark, sf):
    p = plan(spark, sf, "column_splitting")
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in p


@pytest.mark.parametrize("headers", [1, 2])
def test_parted_headers_by_brute_force(spark, headers):
    """Tables with and without headers, headers in two rows, texts that go on, missing places and texts."""
    from quirefold.operators import enrich

    r = random.Random(11)
    rows = [(doc, table, k, k // 6 + (doc == 3) * 2, r.randrange(4), r.choice([None, *(float(10 * x) for x in range(40))]), float(r.randrange(5, 90)), r.choice(["Name", "Name:", "This,", None])) for doc in range(12) for table in (0, 1) for k in range(30)]
    want = {}
    for doc, table in {x[:2] for x in rows}:
        mine = sorted((x for x in rows if x[:2] == (doc, table)), key=lambda x: (x[3], x[5] is not None, x[5] or 0, x[2]))
        spans, last = {}, None
        for x in mine:
            if x[3] < headers:
                if last is None or last[3] != x[3]:
                    k = 0
                elif last[4] != x[4] or (last[7] is not None and not last[7].endswith((":", ","))):
                    k += 1
                last, want[x[:3]] = x, k
                spans.setdefault(k, []).append(x)
        known = lambda f, *v: f(y for y in v if y is not None) if any(y is not None for y in v) else None
        ends = {k: (known(min, *(x[5] for x in xs)), known(max, *(x[5] + x[6] if x[5] is not None else None for x in xs))) for k, xs in spans.items()}
        for x in mine:
            if x[3] >= headers:
                over = []
                for k, (lo, hi) in ends.items():
                    a, b = known(min, *((x[5] + x[6],) if x[5] is not None else ()), hi), known(max, x[5], lo)
                    over.append((a is not None and b is not None, a - b if a is not None and b is not None else 0, -k))
                want[x[:3]] = -max(over)[2] if over else x[4]
    e = spark.createDataFrame(rows, "doc_id long, table_id int, elem_idx int, row int, col int, left double, width double, text string")
    got = enrich.part_header_cells(e, headers)
    assert got.columns == e.columns and {(x.doc_id, x.table_id, x.elem_idx): x.col for x in got.collect()} == want and got.count() == len(rows)
