"""Scalar functions by their truth tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as T

TRUE_FALSE = [
    (T.is_semantically_incomplete, ["$", "€"], ["USD", "$ 1", ""]),
    (T.can_be_connected, ["Name:", "This,", "no. 4."], ["Name", "end."]),
    (T.is_last_line_of_paragraph, ["Line end. Hence forth.", "Only one."], ["Owner: Some Person", "Firm:X.Y.", ""]),
    (T.contains_only_index, ["[3]", "XII,", "▥", "a)", "12."], ["▥ then words", "▥ then words and a stop.", "", "...", "1.2.", "abcd."]),
    (T.is_alphanumeric, ["AB", "VI", "12"], ["aB", "", "a1"]),
    (T.is_roman_number, ["vi", "M", "XIV"], ["iX", "", "abc", "IIII"]),
    (T.is_bullet, ["■"], ["⚠", "", "■■"]),
    (T.is_upper_case, ["LOUD:12"], ["LOud:()", "123", ""]),
    (T.is_lower_case, ["quiet:?;"], ["QUiet:*&", "123", ""]),
    (T.is_number, ["123"], ["a123", "abc", "", "12\n"]),
    (T.is_number_in_any_system, ["123", "iv"], ["iv1", "ivx", "a123", "abc"]),
    (T.is_amount_or_percentage, ["(1,234,567)", "1.75", "-1", "10%", "(5 %)"], ["10abc", "", "()", "-", "%"]),
    (T.is_amount_representation, ["12", "$ 5", "USD 7", "-"], ["abc", "EUR x", ""]),
    (T.means_total, ["Total", "net income", "The subtotal of it:", "sum total:"], ["totally", "network", ""]),
    (T.is_page_number, ["12", "iv", "3-12", "page - 4"], ["page", "3.5-2x", "", "---", "- 7 -"]),
    (T.is_dash_wrapped, ["word-", "a –"], ["-", "word"]),
    (T.is_unique_cell, ["Name:", "(ab)", "-"], ["word", "(abcde)"]),
    (T.is_numeric_date, ["1906", "12/31/99", "31.12.2001", "2001-02-30", "1-2-34", " 5 6 2020 "], ["5000", "13/32/99", "00/01/2000", "1/2-99", "01/01/0000", "2001/03/5", ""]),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("f", "yes", "no"), TRUE_FALSE, ids=[t[0].__name__ for t in TRUE_FALSE])
def test_predicates(spark, f, yes, no):
    rows = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "t string, want boolean").select("t", "want", f("t").alias("got")).collect()
    assert [r.t for r in rows if r.got != r.want] == []
    assert spark.createDataFrame([(None,)], "t string").select(f("t")).first()[0] in (None, False)


@pytest.mark.parametrize(("text", "kind"), [("1906", "DATE"), ("27 Jun 2017", "ALPHANUMERIC"), ("January", "ALPHA"), ("5000", "NUMERIC"), ("--", "NON_ALPHANUMERIC"), ("", "NON_ALPHANUMERIC")])
def test_regex_type(spark, text, kind):
    assert one(spark, T.regex_type(F.lit(text))) == kind


def test_headers(spark):
    cases = [(None, False), ([], False), (["9"], False), (["here the paragraph ends."], False), (["9", "Amount", "9"], False), (["9", "Amount 9"], True), (["9", "Header"], True)]
    rows = spark.createDataFrame(cases, "a array<string>, want boolean").select("want", T.can_be_header("a").alias("got")).collect()
    assert all(r.want == r.got for r in rows)


@pytest.mark.parametrize(("text", "numbers", "words"), [("ftp://ab.cd/x2?y=!7", False, ["ftp", "://", "ab", ".", "cd", "/", "x2", "?", "y", "=!", "7"]), ("v1", True, ["v", "1"]), ("123", False, ["123"]), ("##", False, ["##"]), ("", False, []), (" a  b ", False, ["a", "b"])])
def test_words(spark, text, numbers, words):
    assert one(spark, T.split_words(F.lit(text), numbers)) == words
    indexed = one(spark, T.split_indexed_words(F.lit(text), numbers))
    assert [w.word for w in indexed] == words and all(text[w["index"] :].startswith(w.word) for w in indexed)


def test_words_without_punctuation(spark):
    assert one(spark, T.split_words(F.lit("a, b.c!"), punctuation=False)) == ["a", "b", "c"]


@pytest.mark.parametrize(("a", "b", "same"), [("", "", True), ("abc/xyz", "abc/xyz", True), ("Page 1 of 5", "Page 2 of 5", True), ("IV", "V", True), ("abc1/xyz", "abc/xyz", False), ("a b", "a", False)])
def test_same_but_numbers(spark, a, b, same):
    assert one(spark, T.means_same_but_numbers(F.lit(a), F.lit(b))) == same
    assert one(spark, T.masked_numbers(F.lit(a)) == T.masked_numbers(F.lit(b))) == same


DATES = [("12/31/1999", (1999, 12, 31)), ("31/12/1999", (1999, 12, 31)), ("05.06.07", (2007, 5, 6)), ("2001-02-30", (2001, 2, 28)), ("1906", (1906, 1, 1)), ("27 Jun 2017", (2017, 6, 27)), ("September 3rd, 2010", (2010, 9, 3)), ("1st Sept 2010", (2010, 9, 1)), ("3-Mar-99", (2099, 3, 3)), ("soon", None), ("32/13/1999", None)]


@pytest.mark.parametrize(("text", "date"), DATES)
def test_dates(spark, text, date):
    assert one(spark, T.parsed_date(F.lit(text))) == (date and datetime.date(*date))


def test_others(spark):
    assert one(spark, T.normalize_homoglyphs(F.lit("“a”—b＄"))) == '"a"-b$'
    assert one(spark, T.fix_null_ligatures(F.lit("o\0ice"), F.array(F.lit("office")))) == "office"
    assert one(spark, T.normalize_locational_text(F.lit("  New - York. "))) == "new york"
    assert one(spark, T.is_named_entity(F.lit("New  York."), ["new york"])) and not one(spark, T.is_named_entity(F.lit("Total"), []))
    assert one(spark, T.currency_name(T.currency_symbol(F.lit("cost €5 $3")))) == "EURO"
    assert [one(spark, T.multiplicative_factor(F.lit(t))) for t in ("(in Thousands)", "(in millions)", "x")] == [1000, 1_000_000, 1]
    assert one(spark, T.multiplicative_factor(F.lit("(in millions)"), True)) == 100_000
    assert one(spark, T.statement_type(F.lit("Consolidated Balance Sheets"))) == "Balance Sheet" and one(spark, T.is_consolidated(F.lit("Consolidated balance sheet")))
    assert one(spark, T.hex_color(F.lit(0x0A0B0C))) == "#0A0B0C" and abs(one(spark, T.luminance(F.lit(0xFFFFFF))) - 1) < 1e-9
    assert [one(spark, T.format_length(F.lit(x))) for x in (1.0, 1.5, 1.257)] == ["1pt", "1.5pt", "1.26pt"]
    assert one(spark, T.html_escape(F.lit("<a&'\">"))) == "&lt;a&amp;&#39;&quot;&gt;"
    assert one(spark, T.starts_as_header(F.lit("see http://a.b/c")))
    assert one(spark, T.continues_on_next_page(F.lit("Continued on next page")))


def test_text_is_laid_out_in_one_pass(spark):
    """Lines are cut once a text, and not by expressions that run over every sign; a text of many rows is passed on in parts."""
    from quirefold.sources import text_layout

    many = spark.createDataFrame([(1, "a"), (2, "a b  c\n" * 30000), (3, "z")], "doc_id long, text string").coalesce(1)
    assert [tuple(r) for r in text_layout.text_elements(many).groupBy("doc_id").agg(F.count("*"), F.max("elem_idx")).orderBy("doc_id").collect()] == [(1, 1, 0), (2, 60000, 29999 * 80 + 1), (3, 1, 0)]
    docs = spark.createDataFrame([(1, "a  b\n\n c\td \n" + "x" * 170), (2, None), (3, ""), (4, " \n"), (5, "e")], "doc_id long, text string")
    p = text_layout.text_elements(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in p and "lambda" not in p
    got = [(r.doc_id, r.elem_idx, r.page_no, r.top, r.left, r.width, r.text) for r in text_layout.text_elements(docs).orderBy("doc_id", "elem_idx").collect()]
    assert got == [(1, 0, 0, 36.0, 72.0, 6.0, "a"), (1, 1, 0, 36.0, 90.0, 6.0, "b"), (1, 80, 0, 66.0, 78.0, 6.0, "c"), (1, 81, 0, 66.0, 96.0, 6.0, "d"), *[(1, 80 * k, 0, 84.0 + 12 * (k - 1), 72.0, 6.0 * n, "x" * n) for k, n in ((2, 80), (3, 80), (4, 10))], (5, 0, 0, 36.0, 72.0, 6.0, "e")]


def test_numerals_left_out_agree_with_masks(spark):
    """Texts of one mask are one without numerals, whatever blanks part them: so comparing these first leaves nothing out."""
    every = spark.createDataFrame([(chr(c),) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000], "t string")
    blanks = [r.t for r in every.where(F.regexp_like("t", F.lit(f"[{T.BLANK}]"))).collect()]
    assert set(blanks) == set(T._BLANKS)
    texts = [None, "", "Page 3 of 12", "Page IV of 7", "Page of", "", "7", "mix", "MIX", "dill 4", *[f"No{b}{n}{b}end{b}" for b in blanks for n in (1, 22, "xiv")]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.masked_numbers("t").alias("m"), T.without_numerals("t").alias("k")).collect()
    assert all(a.k == b.k for a in rows for b in rows if a.m == b.m) and len({r.k for r in rows}) == 3


@pytest.mark.parametrize("name", ["invariant_lines", "repeated_lines_across_pages"])
def test_like_lines_are_found_without_a_join(spark, sf, name):
    from quirefold.plans import texts

    p = texts.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in p and p.count("MapInArrow") == 1


def test_repeated_lines_of_several_places(spark):
    """The first of several near ones on the very next page counts; those of other pages, places and words do not."""
    from quirefold.operators import pages

    rows = [(1, 0, 0, 50.0, "Page 1"), (1, 0, 1, 400.0, "Page 9"), (1, 1, 5, 55.0, "Page  II"), (1, 1, 4, 60.0, "Page 2"), (1, 1, 6, 300.0, "Page 3"), (1, 3, 9, 55.0, "Page 4"), (1, 2, 7, 55.0, "Pages 4"), (None, 0, 0, 50.0, "Page 1"), (None, 1, 1, 50.0, "Page 1"), (2, 0, 0, None, "x 1"), (2, 1, 1, 50.0, "x 1")]
    e = spark.createDataFrame(rows, "doc_id long, page_no int, elem_idx int, top double, text string").withColumn("left", F.lit(10.0)).withColumn("height", F.lit(10.0))
    assert [tuple(r) for r in pages.repeated_across_pages(e).collect()] == [(1, 0, 0, 4)]


def test_amounts_by_one_swap_are_those_by_two_kinds(spark):
    """The first sign alone becomes a nought, line ends or not, and only once; a kind that is known is not found again."""
    texts = [None, "", "$", "$5", "5%", "USD 7", "EUR", "a$", "5-3", "1-1-2020", "-1-1-2020", "12\n$3", "--", "€€", "_", "−4", "2020", "12/31/2020", "12.5", "1,000", " 2020 ", "3 4", "x", "0", "1996-03-13", "99 - 1 - 1"]
    sign = r"^([\s\S]*?)(?:\$|%|USD|EUR|€|-|_|−)([\s\S]*)$"
    c = F.col("t")
    twice = F.when(F.regexp_like(c, F.lit(sign)), F.concat(F.regexp_extract(c, sign, 1), F.lit("0"), F.regexp_extract(c, sign, 2))).otherwise(c)
    plain = F.regexp_like(T._date_text("t"), F.lit(T._DIGIT_DATE))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.is_amount_representation("t").alias("a"), T.is_amount_representation("t", T.regex_type("t")).alias("b"), ((T.regex_type("t") == T.NUMERIC) | (T.regex_type(twice) == T.NUMERIC)).alias("w"), T.is_numeric_date("t").alias("d"), plain.alias("p")).collect()
    assert all(bool(r.a) == bool(r.b) == bool(r.w) and r.d == r.p for r in got) and sum(bool(r.a) for r in got) > 8
