"""Headers and footers: greedy matching, repeats, rules, modes and bounds."""

from quirefold.operators import partition as P
from quirefold.options import Options

SCHEMA = "doc_id long, page_no int, elem_idx int, kind string, top double, left double, width double, height double, text string"


def e(top, left=72.0, text="x", **more):
    return {"kind": "text", "solid": True, "top": float(top), "left": float(left), "width": 60.0, "height": 10.0, "text": text, "mask": hash(text), "number": text.isdigit(), "page_number": text.isdigit(), "sign": text in ".,-", "noted": text == "Continues on next page", "again": None, "place": 1, "line_head": False} | more


def pages(spark, texts):
    """A page a list of (top, left, text), in order."""
    rows = [(1, p, k, "text", float(t), float(x), 60.0, 10.0, s) for p, page in enumerate(texts) for k, (t, x, s) in enumerate(page)]
    return spark.createDataFrame(rows, SCHEMA)


BODY = [(150 + 14 * k, 72, f"line {k} of the text") for k in range(20)]


def found(df):
    return {(r.page_no, r.elem_idx): r.partition for r in df.collect() if r.partition != "CONTENT"}


def test_each_takes_its_first_likeness():
    a, b = [e(20, text="a"), e(20, 200, "b")], [e(20, 200, "b"), e(20, text="a")]
    assert P.common(a, b) == 2  # the order need not be the same
    assert P.common([e(20, text="a"), e(34, text="q")], b) == 1
    assert P.common([e(20, text="a"), e(20, 200, "q")], b) == 0  # half a line is none
    assert P.common([e(20, text="a"), e(20, text="a")], [e(20, text="a"), e(34, text="z")]) == 0  # one likeness is taken once, and half a line is none
    # an element more on the next page loses nothing
    assert P.common([e(20, text="a"), e(34, text="c")], [e(20, text="a"), e(27, 400, "new"), e(34, text="c")]) == 1


def test_numbers_alternate():
    # what two pages share holds for the next one too, once
    p = [[e(20, text="a")], [e(20, text="a")], [e(20, text="z")], [e(20, text="y")]]
    assert P.sizes_of(p, False, False) == [1, 1, 0, 0]


def test_repeats_within_the_page_are_content():
    row = [e(20, 72, "Name", again=9, place=1), e(20, 300, "Size", again=10, place=2)]
    assert P.repeated(row, 2) == 2 and P.repeated(row[:1], 1) == 0
    assert P.repeated([row[0], e(20, 300, "Size", again=None, place=2)], 2) == 0


def test_candidates_stop():
    assert len(P.candidates([e(20), e(40), e(300)], 792, 612, False)) == 2
    assert len(P.candidates([e(20, 72 + 90 * k) for k in range(5)] + [e(40)], 792, 612, False)) == 0  # a row of a table
    assert P.candidates([e(20, kind="form"), e(30)], 792, 612, False) == []
    # a paragraph that goes on beyond the limit
    text = [e(90 + 12 * k, text=f"t{k}") for k in range(6)]
    assert len(P.candidates(text, 792, 612, False)) < 3


def test_boxed_tables_extend():
    rows = [e(20 + 14 * k, 72, f"r{k}", box=1, box_height=70.0) for k in range(2)] + [e(130, text="in", box=1, box_height=70.0), e(200, text="out", box=None, box_height=None)]
    assert [x["text"] for x in P.candidates(rows, 792, 612, False, False, True)] == ["r0", "r1", "in"]


def test_modes_and_bounds(spark):
    df = pages(spark, [[(20, 72, f"Report of {1998 + p}"), *BODY, (770, 300, str(p + 1))] for p in range(3)])
    got = P.partitions(df)
    assert found(got) == {**{(p, 0): "HEADER" for p in range(3)}, **{(p, 21): "FOOTER" for p in range(3)}}
    assert {(r.page_no, r.partition): r.part for r in got.select("page_no", "partition", "part").distinct().collect()} == {(p, k): 3 * p + i for p in range(3) for i, k in enumerate(("HEADER", "CONTENT", "FOOTER"))}
    across = P.partitions(df, across=True)
    assert {r.part for r in across.where("partition = 'CONTENT'").collect()} == {0} and across.select("part").distinct().count() == 7
    assert P.partitions(df, exclude=False).select("part").distinct().count() == 3 and P.partitions(df, exclude=False, across=True).select("part").distinct().count() == 1
    assert found(P.partitions(df, options=Options(disable_header_footer_detection=True))) == {}
    b = {(r.first_page, r.partition): (r.top, r.bottom) for r in P.bounds(df, got).collect()}
    assert b[0, "HEADER"] == (0.0, 32.0) and b[0, "CONTENT"] == (32.0, 768.0) and b[0, "FOOTER"] == (768.0, 792.0)
    assert [(r.top, r.bottom) for r in P.bounds(df, across).where("partition = 'CONTENT'").collect()] == [(0.0, 792.0)]


def test_one_page(spark):
    one = pages(spark, [[(20, 72, "see https://a.example/b"), *BODY]])
    assert found(P.partitions(one)) == {} and found(P.partitions(one, regex=True)) == {(0, 0): "HEADER"}
    assert P.partitions(one.limit(0)).count() == 0
    assert found(P.partitions(pages(spark, [[(20, 72, None), *BODY]] * 2).drop("kind"))) == {(0, 0): "HEADER", (1, 0): "HEADER"}
