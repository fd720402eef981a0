"""Layout of drawn pages: context, paragraphs, tables, partitions, rectangles; relational joins against the document engine."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quirefold.api import DocumentFrame
from quirefold.operators import algebra, layout, lines, neighbours, partition, rectangles
from quirefold.options import Options
from quirefold.schema import ELEMENTS
from quirefold.sinks import files, html, visual_json
from quirefold.streaming import arrivals


def page(spark, rows):
    """Elements from (kind, left, top, width, height, text); lines have their stretch as width."""
    out = []
    for k, (kind, left, top, width, height, text, *more) in enumerate(rows):
        line = kind in ("hline", "vline")
        out.append((1, k, more[0] if more else 0, kind, float(top), float(left), None if line else float(width), None if line else float(height), float(width) if line else None, text, "Times", 10.0, [], 0, None))
    return spark.createDataFrame(out, ELEMENTS)


def grid(rows, left=72, top=100, pitch=100, step=14):
    return [("text", left + pitch * c, top + step * r, 6 * len(t), 10, t) for r, row in enumerate(rows) for c, t in enumerate(row) if t]


def test_table_and_paragraph(spark):
    body = [("text", 72, 300, 400, 10, "A paragraph that goes on"), ("text", 72, 312, 400, 10, "over two lines"), ("text", 72, 400, 380, 10, "and another")]
    e = page(spark, grid([["Item", "Units", "Price"], ["nut", "12", "3"], ["bolt", "7", "9"]]) + body)
    ctx = layout.document_layout(e)
    rows = {r.elem_idx: r for r in ctx.collect()}
    cells = {(r.row, r.col): r.text for r in layout.cells_of(e, ctx).collect()}
    assert cells == {(r, c): t for r, row in enumerate([["Item", "Units", "Price"], ["nut", "12", "3"], ["bolt", "7", "9"]]) for c, t in enumerate(row)}
    assert rows[9].vg_id == rows[10].vg_id != rows[11].vg_id and rows[9].table_id is None
    assert rows[0].shadow_below == 3 and rows[3].shadow_above == 0 and rows[0].shadow_right == 1 and rows[1].shadow_left == 0 and rows[0].shadow_above is None
    off = layout.document_layout(e, Options(disable_table_detection=True))
    assert off.where("table_id IS NOT NULL").count() == 0


def test_borders_bound_elements(spark):
    e = page(spark, [("text", 100, 100, 40, 10, "in"), ("text", 300, 100, 40, 10, "out"), ("vline", 160, 90, 40, 0, None), ("hline", 90, 120, 100, 0, None)])
    r = layout.document_layout(e).where("elem_idx = 0").first()
    assert r.vis_right == 160 and r.border_right and r.vis_bottom == 120 and r.border_bottom and not r.border_left


def test_empty_and_odd(spark):
    e = page(spark, [("text", 0, 0, 0, 0, None), ("text", 0, 0, 0, 0, ""), ("image", 10, 10, 5, 5, None), ("hline", 0, 50, 10, 0, None)])
    assert layout.document_layout(e).count() == 3
    assert layout.document_layout(e.limit(0)).count() == 0 and lines.page_structure(e.limit(0)).count() == 0


@pytest.mark.parametrize("direction", ["below", "above", "left", "right"])
def test_joins_against_all_pairs(spark, direction):
    rng = random.Random(7)
    boxes = [("text", rng.randrange(0, 500), rng.randrange(0, 3000), rng.randrange(5, 120), rng.choice([8, 10, 14]), "x") for _ in range(220)]
    e = page(spark, boxes)
    got = neighbours.shadow_vertical(e, direction == "below") if direction in ("below", "above") else neighbours.shadow_horizontal(e, direction == "right")
    found = {r.elem_idx: r.shadow for r in got.collect()}
    s = layout.Sheet(e.toPandas())
    place = {int(i): k for k, i in enumerate(s.idx)}
    for i, k in place.items():
        if direction in ("left", "right"):
            want = s.beside(k, direction == "right")
        else:
            f = s.below if direction == "below" else s.above
            want = f(s.top[k] if direction == "below" else s.bottom[k], s.left[k], s.right[k], s.left[k], s.right[k])
        assert found.get(i, -1) == (int(s.idx[want]) if want >= 0 else -1)


@pytest.mark.parametrize("direction", ["below", "above", "left", "right"])
def test_neighbour_lists_against_the_engine(spark, direction):
    rng = random.Random(8)
    e = page(spark, [("text", rng.randrange(0, 500), rng.randrange(0, 900), rng.randrange(5, 90), 10, "x") for _ in range(120)])
    s = layout.Sheet(e.toPandas())
    s.find_context()
    spans = spark.createDataFrame([(int(s.idx[k]), *[float(s.vis[x][k]) for x in ("left", "right", "top", "bottom")]) for k in range(s.n)], "elem_idx int, vis_left double, vis_right double, vis_top double, vis_bottom double")
    got = {r.elem_idx: r.ids for r in neighbours.neighbour_lists(e.join(spans, "elem_idx"), direction).collect()}
    assert {int(s.idx[k]): [int(s.idx[c]) for c in s.near[direction][k]] for k in range(s.n) if s.near[direction][k]} == got


def test_reading_order(spark):
    e = page(spark, [("text", 300, 101, 20, 10, "b"), ("text", 72, 100, 20, 10, "a"), ("text", 72, 130, 20, 10, "d"), ("text", 400, 99, 20, 10, "c")])
    assert [r.text for r in lines.reading_order(e).orderBy("elem_idx").collect()] == ["a", "b", "c", "d"]


def test_headers_and_footers(spark):
    rows = []
    for p in range(3):
        rows += [("text", 72, 30, 100, 10, "Annual report", p), *[("text", 72, 200 + 14 * k, 300, 10, f"line {chr(97 + k)} of page {'xyz'[p]}", p) for k in range(6)], ("text", 300, 760, 20, 10, f"{p + 1}", p)]
    got = {(r.page_no, r.elem_idx): r.partition for r in partition.partitions(page(spark, rows)).collect()}
    for p in range(3):
        assert [got[p, 8 * p + k] for k in range(8)] == ["HEADER", *["CONTENT"] * 6, "FOOTER"]


def test_rectangles(spark):
    lines_ = [("hline", 10, 10 + 20 * k, 60, 0, None) for k in range(3)] + [("vline", 10 + 30 * k, 10, 40, 0, None) for k in range(3)] + [("hline", 300, 300, 50, 0, None)]
    found = rectangles.rectangles(page(spark, lines_))
    assert {(r.top, r.left, r.width, r.height, r.n_rows, r.n_cols) for r in found.collect()} == {(y, x, 30.0, 20.0, 2, 2) for y in (10.0, 30.0) for x in (10.0, 40.0)}
    box = rectangles.bounding_boxes(found).collect()
    assert [(b.top, b.left, b.width, b.height) for b in box] == [(10.0, 10.0, 60.0, 40.0)]
    assert rectangles.rectangles(page(spark, lines_[:1])).count() == 0


def cells(spark, rows):
    return spark.createDataFrame([(1, 0, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)], "doc_id long, table_id int, row int, col int, text string")


def test_hierarchy(spark):
    firsts = spark.createDataFrame([(1, 0, r, left, f"t{r}") for r, left in enumerate([36.0, 36.0, 36.0, 48.0, 60.0, 48.0, 36.0, None, 48.0])], "doc_id long, table_id int, row int, left double, text string")
    got = {r.row: (r.level, r.parent, r.path) for r in algebra.hierarchy(firsts).collect()}
    assert [got[k][0] for k in range(9)] == [0, 0, 0, 1, 2, 1, 0, 0, 1]
    assert got[4][1] == 3 and got[4][2] == "t2/t3/t4" and got[5][1] == 2 and got[2][1] is None


def test_deleted_rows_give_their_text_on(spark):
    c = cells(spark, [["h", "g"], ["a", "x"], ["", "y"], ["", "z"]]).withColumn("v_merged", (F.col("col") == 0) & (F.col("row") > 1))
    got = {(r.row, r.col): (r.text, r.v_merged) for r in algebra.delete_rows(c, F.col("row") == 1).collect()}
    assert got == {(0, 0): ("h", False), (0, 1): ("g", False), (1, 0): ("a", False), (1, 1): ("y", False), (2, 0): ("", True), (2, 1): ("z", False)}


def test_wrapped_rows(spark):
    got = {(r.row, r.col): r.text for r in algebra.merge_wrapped(cells(spark, [["Name", "Sum"], ["A long", "5"], ["title", ""], ["Next", "6"]])).collect()}
    assert got[1, 0] == "A long\ntitle" and got[2, 0] == "Next" and len(got) == 6


def test_json_and_html(spark, tmp_path):
    e = page(spark, [("text", 72, 100, 30, 10, "a<b"), ("text", 200, 100, 30, 10, "c"), ("text", 72, 200, 30, 10, "d")])
    doc = json.loads(visual_json.phrases(e).first().json)
    groups = doc["pages"][0]["groups"]
    assert [[[s["text"] for s in line["segments"]] for line in g["lines"]] for g in groups] == [[["a<b", "c"]], [["d"]]]
    assert groups[0]["lines"][0]["segments"][0]["box"] == {"b": 110.0, "l": 72.0, "r": 102.0, "t": 100.0} and list(groups[0]["lines"][0]["segments"][0]) == sorted(groups[0]["lines"][0]["segments"][0])
    t = json.loads(visual_json.tables(cells(spark, [["H", "$"], ["a", "1"]])).first().json)
    assert t["metadata"]["currencyName"] == "DOLLAR" and t["data"][1]["cells"][0]["text"] == "a" and t["columns"][0]["title"] == "H"
    both = json.loads(visual_json.combined(e, cells(spark, [["H"], ["a"]])).first().json)
    assert set(both) == {"phrases", "tables"} and len(both["tables"]) == 1
    page_html = html.render(e).first().html
    assert "a&lt;b" in page_html and page_html.count("<div style") == 3
    files.write_kinds(str(tmp_path / "out"), phrase=visual_json.phrases(e), html=html.render(e))
    assert {r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"phrase", "html"}


def test_options():
    o = Options.from_json('[{"customizationType": "DisableTableDetection", "params": ["true"]}, {"customizationType": "TABULAR_NOISE_PATTERNS", "params": ["x+"]}, {"customizationType": "MaxPagesAllowed", "params": ["7"]}]')
    assert o.disable_table_detection and o.tabular_noise_patterns == ("x+",) and o.max_pages_allowed == 7
    for asked in ('{"customizationType": "PagesToOcr", "params": ["1", "2"]}', '{"customizationType": "Scanned"}'):
        with pytest.raises(NotImplementedError, match="images"):
            Options.from_json(f"[{asked}]")
    assert Options.command_line().combine_and_override_with(Options(line_merge_epsilon=3.0)).line_merge_epsilon == 3.0
    with pytest.raises(ValueError, match="unknown"):
        Options.from_json('[{"customizationType": "Nothing"}]')


def test_facade_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One line\nTwo  columns"), (2, None), (3, "")], "doc_id long, text string")
    d = DocumentFrame.from_texts(docs)
    assert d.paragraphs().count() == 2 and d.lines().count() == 3 and d.merged().elements.count() == 3
    d.create_views("t_")
    assert spark.sql("SELECT count(*) FROM t_elements").first()[0] == 3
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One\nTwo")
    arrivals.structure_stream(arrivals.watch_texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().n_lines == 2
