"""Glyphs to segments: aligned gaps, rescue of covered glyphs, fonts, awkward pages."""

import pytest
from pyspark.sql import functions as F

from quirefold.operators import glyphs as O
from quirefold.sources import glyphs as S


@pytest.fixture(scope="module")
def page(spark):
    def make(*lines, doc=1):
        return S.typeset(spark.createDataFrame([(doc, 0, "\n".join(lines))], "doc_id long, page_no int, text string"))

    return make


def words(g):
    plain = g.withColumns({"mode": F.lit("fill"), "fill_alpha": F.lit(1.0), "fill_rgb": F.lit(0), "luminous": F.lit(False), "shear_y": F.lit(0.0), "bg_op": F.lit(0), "inside_clip": F.lit(True), "height": F.lit(8.0)})
    return O.with_words(O.with_fonts(O.visible(plain)))


def gaps(spark, rows, reach):
    lines = [[(float(a), float(b)) for a, b in r] for r in rows]
    return O._aligned(lines, [(float(a), float(b)) for a, b in reach])


def test_gaps_that_line_up(spark):
    full = [(0, 300)] * 6
    assert gaps(spark, [[(100, 120)]] * 6, full) == {(k, 0) for k in range(6)}
    # the common part has to stay
    assert gaps(spark, [[(100, 120)], [(115, 140)], [(135, 150)]] + [[]] * 4, [(0, 300)] * 7) == set()
    # to the page's end fewer lines do
    assert gaps(spark, [[(100, 120)], [(105, 130)]], [(0, 300)] * 2) == {(0, 0), (1, 0)}
    # lines that stand beside the gap are passed over, two together at most
    assert gaps(spark, [[(9, 10)], [(100, 120)], [], [], [(100, 110)]], [(0, 300), (0, 300), (0, 90), (130, 200), (0, 300)]) >= {(1, 0), (4, 0)}
    assert (1, 0) not in gaps(spark, [[(9, 10)], [(100, 120)], [], [], [], [(100, 110)]], [(0, 300), (0, 300), (0, 90), (0, 90), (0, 90), (0, 300)])


def test_columns_part_where_gaps_line_up(spark, page):
    w = words(page(*["alpha, beta gamma"] * 6))
    t = O.word_table(w)
    loose, tight = O.breaks(t), O.breaks(t, aligned=O.aligned_gaps(t))
    assert loose.where("spacing_break").count() == 6 and tight.where("spacing_break").count() == 12
    assert {r.text for r in O.segments(tight).collect()} == {"alpha,", "beta gamma"}
    assert {r.text for r in O.segments(loose).collect()} == {"alpha,  beta gamma"}


def test_alternates_keep_styles(spark, page):
    s = O.segments(O.breaks(O.word_table(words(page("one Two three"))))).collect()
    assert [r.text for r in s] == ["one Two three"] and [a.text for a in s[0].alternates] == ["one", "Two", "three"]
    assert [a.styles for a in s[0].alternates] == [[], ["bold"], []]
    assert O.segments(O.breaks(O.word_table(words(page("one Two three"))), by_font=False)).first().alternates is None


def test_filter_states(spark, page):
    g = page("abcdefgh").withColumns({"shear_y": F.lit(0.0), "height": F.lit(8.0), "luminous": F.col("ch") == "b", "mode": F.when(F.col("ch") == "a", "neither").otherwise("fill"), "fill_alpha": F.when(F.col("ch") == "c", 0.0).otherwise(1.0), "fill_rgb": F.when(F.col("ch") == "d", 0xFFFFFF).when(F.col("ch") == "e", 0xEEEEEE).otherwise(0), "inside_clip": F.col("ch") != "f"})
    assert {r.ch: r.state for r in O.seen(g).collect()} == {**dict.fromkeys("abcde", "dropped"), "f": "covered", "g": "kept", "h": "kept"}
    # one of three is covered: it is shown; all covered: none is
    assert {r.ch for r in O.visible(g).collect()} == {"f", "g", "h"}
    assert O.visible(g.withColumn("inside_clip", F.lit(False))).count() == 0


def test_fonts():
    from quirefold.functions import fonts

    assert all(len(w) == 95 for w in fonts.WIDTHS.values())


def test_letter_spacing(spark):
    from quirefold.functions import fonts

    df = spark.createDataFrame([("aaaaaaaaaa", 60.0, 10.0), ("aaaaaaaaaa", 68.0, 10.0), ("aaaaaaaaaa", 90.0, 10.0), ("aaaaaaaaaa", 30.0, 10.0), ("", 30.0, 10.0)], "t string, w double, s double")
    spacing, size = fonts.letter_spacing("w", "s", "t", F.lit("Courier"))
    got = [(round(r[0], 4), round(r[1], 4)) for r in df.select(spacing, size).collect()]
    assert got == [(0.0, 10.0), (0.08, 10.0), (0.1, 10.0), (-0.1, 6.0), (0.0, 10.0)]


def test_awkward(spark):
    empty = S.typeset(spark.createDataFrame([(1, 0, None), (2, 0, ""), (3, 0, "  \n ")], "doc_id long, page_no int, text string"))
    t = O.word_table(O.with_words(O.with_fonts(O.visible(empty))))
    assert t.count() == 0 and O.segments(O.breaks(t)).count() == 0 and O.aligned_gaps(t).count() == 0
    assert O.spacing_scaled(O.with_words(O.with_fonts(O.visible(empty)))).count() == 0


def test_strokes(spark):
    df = spark.createDataFrame([(1, 10.0, 10.0, 100.0, 12.0, 0), (2, 10.0, 10.0, 12.0, 100.0, 0), (3, 10.0, 10.0, 100.0, 100.0, 0), (4, 10.0, 10.0, 100.0, 10.0, 0xFFFFFF), (5, 10.0, 10.0, 14.0, 10.0, 0), (6, 600.0, 10.0, 700.0, 10.0, 0), (7, 700.0, 10.0, 800.0, 10.0, 0), (8, 100.0, 10.0, 10.0, 10.0, None)], "n int, x1 double, y1 double, x2 double, y2 double, rgb int").withColumn("alpha", F.lit(1.0))
    got = {r.n: (r.kind, r.top, r.left, r.stretch) for r in O.strokes_to_lines(df).collect()}
    assert got == {1: ("hline", 782.0, 10.0, 90.0), 2: ("vline", 692.0, 12.0, 90.0), 6: ("hline", 782.0, 600.0, 12.0), 8: ("hline", 782.0, 10.0, 90.0)}
