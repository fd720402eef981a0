"""Table splitting, merging and totals on small tables; walks and joins on awkward rows."""

from pyspark.sql import functions as F

from quirefold.operators import scans as S
from quirefold.operators import tables as O


def cells(spark, rows, **more):
    flat = [(1, 0, r, c, t, ["bold"] if r in more.get("bold", ()) else [], 255 if r in more.get("blue", ()) else 0, 10.0, 6.0 * len(t)) for r, row in enumerate(rows) for c, t in enumerate(row)]
    return spark.createDataFrame(flat, "doc_id long, table_id int, row int, col int, text string, styles array<string>, rgb int, height double, width double")


TWO = [["Year", "Sum"], ["1", "20"], ["2", "30"], ["City", "Name"], ["a", "b"], ["c", "d"]]


def test_second_header_splits(spark):
    c = cells(spark, TWO, bold=(0, 3))
    assert [r.row for r in O.split_candidates(c).collect()] == [3]
    assert [r.row for r in O.splits(c).collect()] == [3]
    got = {(r.part, r.row, r.col): r.text for r in O.split_at(c, O.splits(c)).collect()}
    assert got[1, 0, 0] == "City" and got[1, 2, 1] == "d" and got[0, 2, 1] == "30" and len(got) == 12
    # without style it is a header of little confidence
    assert O.splits(cells(spark, TWO)).count() == 0
    again = O.split_at(c, O.splits(c)).where("part = 1")
    assert O.splits(again).count() == 0


def test_colour_and_filling_go_on_through_columns(spark):
    v = {r.row: r for r in O.row_votes(cells(spark, [["a", ""], ["", "b"]], blue=(1,))).collect()}
    assert (v[0].fill, v[1].fill) == (1, 2) and v[1].colour == 1 and v[0].filled == 1


def test_narrow_columns(spark):
    rows = [["Sum", "", "", "Year"], ["$", "5", "", "1"], ["", "6", "%", "2"]]
    got = {(r.row, r.col): r.text for r in O.merge_narrow_columns(cells(spark, rows)).collect()}
    assert got == {(0, 0): "Sum", (0, 1): "", (0, 2): "Year", (1, 0): "$\t5", (1, 1): "", (1, 2): "1", (2, 0): "6", (2, 1): "%", (2, 2): "2"}
    assert O.merge_narrow_columns(cells(spark, rows).limit(0)).count() == 0


def test_total_rows(spark):
    rows = [["x", "n"], ["a", "1"], ["b", "2"], ["Total", "3"], ["c", "4"]]
    t = lambda c, **k: [r.row for r in O.total_rows(c, **k).orderBy("row").collect()]
    assert t(cells(spark, rows)) == [3]
    # words decide among the rows that look different; a bold row without words does not count beside them
    assert t(cells(spark, rows, bold=(3, 4))) == [3]
    plain = [[a.replace("Total", "d"), b] for a, b in rows]
    assert t(cells(spark, plain, bold=(4,))) == [4] and t(cells(spark, plain)) == []
    ruled = cells(spark, plain).withColumns({"border_top": F.col("row") == 3, "above_text": F.lit("7"), "below_text": F.lit("c")})
    assert t(ruled) == [3] and t(ruled, lines_significant=True) == []
    assert t(cells(spark, [["x", "n"], *[["Total", str(k)] for k in range(4)]])) == []  # a long run
    assert t(cells(spark, rows).limit(0)) == []


def test_scan_both_ways(spark):
    e = spark.createDataFrame([(1, k, t) for k, t in enumerate("swxwsxww")], "doc_id long, elem_idx int, t string")
    on = lambda c: F.col("t") == c
    walk = lambda **k: sorted((r.start_idx, r.elem_idx) for r in S.scan(e, on("s"), on("w"), on("x"), **k).collect())
    assert walk() == [(0, 1)] and walk(forward=False) == [(4, 3)]
    assert sorted((r.start_idx, r.elem_idx) for r in S.scan(e, on("w"), on("w"), on("x"), own=True).collect()) == [(1, 1), (3, 3), (6, 6), (6, 7), (7, 7)]
    assert {r.size for r in S.kth_position(e, on("w"), 3, within=("doc_id",)).collect()} == {7} and {r.size for r in S.kth_position(e, on("w"), 9, within=("doc_id",)).collect()} == {0}


def test_read_phrases(spark):
    w = [(1, 0, k, t, x, y, 20.0, 10.0, 10.0, 3.0, b, False) for k, (t, x, y, b) in enumerate([("one", 0.0, 0.0, True), ("two", 25.0, 1.0, True), ("far", 80.0, 0.0, False), ("next", 0.0, 14.0, None)])]
    df = spark.createDataFrame(w, "doc_id long, page_no int, word_id long, text string, left double, top double, width double, height double, font_size double, space_width double, bold boolean, italic boolean")
    assert [(r.text, r.styles, r.width) for r in S.ocr_phrases(df).orderBy("phrase").collect()] == [("one two", ["bold"], 45.0), ("far", [], 20.0), ("next", [], 20.0)]
    assert S.ocr_phrases(df.limit(0)).count() == 0


def test_plural_header_and_underline(spark):
    e = spark.createDataFrame([(1, 0, 0.0, 10.0, "head"), (1, 1, 20.0, 10.0, "abc"), (1, 2, 21.0, 10.0, "def"), (1, 3, 40.0, 10.0, "ghi"), (1, 4, 20.0, 10.0, "x")], "doc_id long, elem_idx int, top double, height double, text string")
    below = spark.createDataFrame([(1, 0, [1, 2]), (1, 9, [1, 3]), (1, 8, [1, 4])], "doc_id long, elem_idx int, ids array<int>")
    assert [r.elem_idx for r in S.plural_header(e, below).collect()] == [0]
    u = spark.createDataFrame([(12.0, True, 30.0), (28.0, True, 30.0), (12.0, False, 30.0), (12.0, True, None)], "vis_bottom double, border_bottom boolean, below_top double").withColumns({"top": F.lit(0.0), "height": F.lit(10.0), "font_size": F.lit(10.0)})
    assert [r.underlined for r in S.underlined_border(u).collect()] == [True, False, False, True]
