"""Queries on texts laid out as pages, and scalar functions over their words and lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lines as L
from ..operators import pages as P
from ..sources import html
from ..sources import text_layout as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return S.text_elements(_docs(spark, d))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


WITH = f"WITH {S.LINES_SQL}, {S.SEGMENTS_SQL}"
LINED = f"{WITH}, {L.LINED_SQL}"


@query("text_elements", f'{WITH} SELECT doc_id, elem_idx, page_no, top::DOUBLE AS top, "left"::DOUBLE AS "left", width::DOUBLE AS width, text FROM elements')
def text_elements(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).select("doc_id", "elem_idx", "page_no", "top", "left", "width", "text")


@query("page_structure", f"""{LINED} SELECT doc_id, page_no, max(grp) + 1 AS n_groups, max(line) + 1 AS n_lines, count(*) AS n_segments, (max("left" + width) - min("left"))::DOUBLE AS text_width, (max(top + height) - min(top))::DOUBLE AS text_height
  FROM grouped GROUP BY doc_id, page_no""")
def page_structure(spark: SparkSession, d: str) -> DataFrame:
    return L.page_structure(_elements(spark, d))


@query("line_segments", f"{LINED} SELECT doc_id, page_no, elem_idx, line, grp FROM grouped")
def line_segments(spark: SparkSession, d: str) -> DataFrame:
    return L.with_groups(L.with_lines(_elements(spark, d))).select("doc_id", "page_no", "elem_idx", "line", "grp")


@query("group_text_join", f"""{LINED}, rowed AS (SELECT doc_id, page_no, grp, line, string_agg(text, chr(9) ORDER BY elem_idx) AS t FROM grouped GROUP BY ALL)
SELECT doc_id, page_no, grp, string_agg(t, chr(10) ORDER BY line) AS text FROM rowed GROUP BY ALL""")
def group_text_join(spark: SparkSession, d: str) -> DataFrame:
    return L.group_texts(_elements(spark, d))


@query("segmentation_ratio", f"""{LINED}, p AS (SELECT doc_id, page_no, count(*) AS n, max(line) + 1 AS k FROM lined GROUP BY ALL)
SELECT doc_id, round(sum(n) / sum(k), 9) AS ratio FROM p GROUP BY doc_id""")
def segmentation_ratio(spark: SparkSession, d: str) -> DataFrame:
    return L.segmentation_ratio(_elements(spark, d)).select("doc_id", F.round("ratio", 9).alias("ratio"))


_G = ", ".join(f"count(*) FILTER (WHERE gap > {c}) + 1 AS g{k}" for k, c in enumerate(L.CANDIDATES))


@query("adaptive_paragraph_factor", f"""{LINED}, gaps AS (SELECT doc_id, page_no, line, CASE WHEN l0 <> line THEN (top - t0 - h0) / h0 END AS gap FROM stepped),
n AS (SELECT doc_id, page_no, max(line) + 1 AS lines, {_G} FROM gaps GROUP BY ALL)
SELECT doc_id, page_no, (CASE WHEN lines <= 5 OR (g0 > 2 AND g0 * 2 < lines) THEN 1.5
  WHEN g0 * 2 >= lines THEN CASE WHEN g3 > 2 AND g3 * 2 < lines THEN 2.0 WHEN g4 > 2 AND g4 * 2 < lines THEN 2.5 ELSE 3.0 END
  WHEN g1 > 2 AND g1 * 2 < lines THEN 1.25 WHEN g1 * 2 >= lines THEN 1.5 WHEN g2 > 2 AND g2 * 2 < lines THEN 1.0 WHEN g2 * 2 >= lines THEN 1.25 ELSE 0.75 END)::DOUBLE AS factor FROM n""")
def adaptive_paragraph_factor(spark: SparkSession, d: str) -> DataFrame:
    return L.adaptive_factor(_elements(spark, d))


@query("single_column_test", f"""{WITH}, mid AS (SELECT * FROM elements WHERE top > 150 AND top < 642),
m AS (SELECT *, lag(top) OVER w AS t0, lag(height) OVER w AS h0, lag("left" + width) OVER w AS r0, lag(elem_idx) OVER w AS e0 FROM mid WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY elem_idx)),
f AS (SELECT *, e0 IS NULL OR NOT {L.same_line_sql("t0", "h0", "top", "height")} AS first FROM m),
g AS (SELECT *, sum(first::INT) OVER (PARTITION BY doc_id, page_no ORDER BY elem_idx) AS line FROM f),
l AS (SELECT doc_id, page_no, line, greatest(coalesce(max(CASE WHEN NOT first THEN least(("left" - r0) / 70, 2) END), 0), 0) AS gap, max(CASE WHEN first AND "left" > 150 THEN 1 ELSE 0 END) AS shifted FROM g GROUP BY ALL),
p AS (SELECT doc_id, page_no, avg(gap) AS gap, avg(shifted) AS shifted FROM l GROUP BY ALL)
SELECT e.doc_id, e.page_no, round(coalesce(gap, 0), 9) AS gap, round(coalesce(shifted, 0), 9) AS shifted, coalesce(gap, 0) < 0.2 AND coalesce(shifted, 0) < 0.4 AS single
FROM (SELECT DISTINCT doc_id, page_no FROM elements) e LEFT JOIN p ON e.doc_id = p.doc_id AND e.page_no = p.page_no""")
def single_column_test(spark: SparkSession, d: str) -> DataFrame:
    return L.single_column(_elements(spark, d)).select("doc_id", "page_no", F.round("gap", 9).alias("gap"), F.round("shifted", 9).alias("shifted"), "single")


@query("page_merge", f"""{WITH}, moved AS (SELECT doc_id, page_no, 1 AS k, elem_idx, 'text' AS kind, top + page_no * 792 AS top FROM elements
  UNION ALL SELECT DISTINCT doc_id, page_no, 0, -1, 'page_break', page_no * 792 FROM elements WHERE page_no > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, k, elem_idx) - 1 AS elem_idx, page_no, kind, top::DOUBLE AS top FROM moved""")
def page_merge(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d)
    return P.merge_pages(e, S.pages_of(e))[0].select("doc_id", "elem_idx", "page_no", "kind", "top")


@query("page_break_numbers", f"""{WITH} SELECT doc_id, page_no, count(*) AS n FROM elements GROUP BY ALL""")
def page_break_numbers(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d)
    merged = P.merge_pages(e, S.pages_of(e))[0]
    return L.between_page_breaks(merged).where("kind = 'text'").groupBy("doc_id", F.col("break_no").alias("page_no")).agg(F.count("*").alias("n"))


@query("blank_space_adjustment", f"""{WITH}, m AS (SELECT doc_id, elem_idx, top + page_no * 792 AS top, height FROM elements),
r AS (SELECT *, max(top + height) OVER (PARTITION BY doc_id ORDER BY top, elem_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m)
SELECT doc_id, elem_idx, (top - sum(greatest(top - coalesce(reach, top) - 150, 0)) OVER (PARTITION BY doc_id ORDER BY top, elem_idx ROWS UNBOUNDED PRECEDING))::DOUBLE AS top FROM r""")
def blank_space_adjustment(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d).select("doc_id", "elem_idx", (F.col("top") + F.col("page_no") * 792.0).alias("top"), "height")
    return P.close_gaps(e).select("doc_id", "elem_idx", "top")


# --- words

_SEP = "[:punct:]\\p{Cf}[:space:]" + "".join(f"\\x{{{ord(c):x}}}" for c in T._MORE)
_BLANKS = "\\s\\p{Z}\\x0b\\x1c-\\x1f"


def words_sql(text: str) -> str:
    """A list of the words and separators of a text."""
    each = f"regexp_extract_all({text}, '[^{_SEP}]+|[{_SEP}]+')"
    return f"list_filter(list_transform({each}, lambda x: regexp_replace(regexp_replace(x, '^[{_BLANKS}]+', ''), '[{_BLANKS}]+$', '')), lambda x: x <> '')"


_ROMAN = T.ROMAN.replace("(?=.)", "")
NUMBER_SQL = "regexp_full_match({0}, '[0-9]+')"


def roman_sql(c: str) -> str:
    return f"({c} <> '' AND (regexp_matches({c}, '{_ROMAN}') OR regexp_matches({c}, '{_ROMAN.lower()}')))"


def any_number_sql(c: str) -> str:
    return f"({NUMBER_SQL.format(c)} OR {roman_sql(c)})"


def mask_sql(text: str) -> str:
    return f"array_to_string(list_transform({words_sql(text)}, lambda w: CASE WHEN {any_number_sql('w')} THEN '#' ELSE '=' || w END), chr(1))"


@query("words_split", f"""WITH w AS (SELECT doc_id, {words_sql("text")} AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: NOT regexp_matches(x, '^[{_SEP}]'))) AS n_words, md5(array_to_string(w, chr(1))) AS digest FROM w""")
def words_split(spark: SparkSession, d: str) -> DataFrame:
    w = _docs(spark, d).where("text IS NOT NULL").select("doc_id", T.split_words("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.filter("w", lambda x: ~F.regexp_like(x, F.lit(f"^[{T.SEPARATOR}]")))).cast("long").alias("n_words"), F.md5(F.array_join("w", "\u0001").cast("binary")).alias("digest"))


@query("words_indexed", f"""WITH e AS (SELECT doc_id, line_no, text FROM lines),
x AS (SELECT doc_id, line_no, unnest(regexp_extract_all(text, '[0-9]+|[^0-9{_SEP}]+|[{_SEP}]+')) AS w, generate_subscripts(regexp_extract_all(text, '[0-9]+|[^0-9{_SEP}]+|[{_SEP}]+'), 1) AS k FROM e),
a AS (SELECT *, sum(length(w)) OVER (PARTITION BY doc_id, line_no ORDER BY k) - length(w) AS pos FROM x),
t AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(w, '^[{_BLANKS}]+', ''), '[{_BLANKS}]+$', '') AS word, pos + length(w) - length(regexp_replace(w, '^[{_BLANKS}]+', '')) AS index, NOT regexp_matches(w, '^[{_SEP}]') AS is_word FROM a)
SELECT doc_id, line_no, index, word, is_word FROM t WHERE word <> ''""".replace("WITH e", f"WITH {S.LINES_SQL}, e", 1))
def words_indexed(spark: SparkSession, d: str) -> DataFrame:
    return S.layout_words(_docs(spark, d))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    both = _docs(spark, d).select("text").unionByName(spark.read.parquet(f"{d}/conversations.parquet").select("text"))
    return both.select(F.explode(F.regexp_extract_all("text", F.lit("([^ \t\r\n]+)"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


TOKENS = "WITH tokens AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS token FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) GROUP BY token)"


def date_sql(c: str) -> str:
    """Whether a text is a date in digits."""
    t = f"replace(regexp_replace(trim({c}), '[\\s\\x{{a0}}]+', ' ', 'g'), chr(8722), '-')"
    out = [f"regexp_full_match({t}, '[12][0-9]{{3}}')"]
    for sep in ("/", " ", "\\.", "-"):
        short = f"'^([0-3]?[0-9]){sep}([0-3]?[0-9]){sep}([0-9]{{2}}|[0-9]{{4}})$'"
        a, b, y = (f"try_cast(nullif(regexp_extract({t}, {short}, {k}), '') AS INT)" for k in (1, 2, 3))
        ok = f"(({y} > 0 OR length(regexp_extract({t}, {short}, 3)) = 2) AND {a} BETWEEN 1 AND 31 AND {b} BETWEEN 1 AND 31 AND ({a} <= 12 OR {b} <= 12))"
        out.append(f"coalesce({ok}, false)")
        for day in ("[0-3][0-9]", "[1-3]?[0-9]"):
            big = f"'^([0-9]{{2}}|[0-9]{{4}}){sep}({day}){sep}({day})$'"
            y, m, dd = (f"try_cast(nullif(regexp_extract({t}, {big}, {k}), '') AS INT)" for k in (1, 2, 3))
            out.append(f"coalesce(({y} > 0 OR length(regexp_extract({t}, {big}, 1)) = 2) AND {m} BETWEEN 1 AND 12 AND {dd} BETWEEN 1 AND 31, false)")
    return "(" + " OR ".join(out) + ")"


def type_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[a-zA-Z]') THEN CASE WHEN regexp_matches({c}, '[0-9]') THEN 'ALPHANUMERIC' ELSE 'ALPHA' END WHEN {date_sql(c)} THEN 'DATE' WHEN regexp_matches({c}, '[0-9]') THEN 'NUMERIC' ELSE 'NON_ALPHANUMERIC' END"


@query("regex_type_tokens", f"""{TOKENS}, k AS (SELECT token, n, {type_sql("token")} AS kind FROM tokens)
SELECT token, n, kind, CASE kind WHEN 'ALPHANUMERIC' THEN 4 WHEN 'ALPHA' THEN 3 WHEN 'DATE' THEN 2 WHEN 'NUMERIC' THEN 1 ELSE 0 END AS priority, regexp_matches(token, '[a-zA-Z]') AS alphabets, regexp_matches(token, '[0-9]') AS digits FROM k""")
def regex_type_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("token", "n", T.regex_type("token").alias("kind"), T.type_priority("token").alias("priority"), T.has_alphabets("token").alias("alphabets"), T.has_numeric_content("token").alias("digits"))


@query("number_roman_tokens", f"""{TOKENS} SELECT token, n, {NUMBER_SQL.format("token")} AS number, {roman_sql("token")} AS roman, {any_number_sql("token")} AS any_system, regexp_full_match(token, '[A-Z]+|[a-z]+|[0-9]+') AS alphanumeric FROM tokens""")
def number_roman_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("token", "n", T.is_number("token").alias("number"), T.is_roman_number("token").alias("roman"), T.is_number_in_any_system("token").alias("any_system"), T.is_alphanumeric("token").alias("alphanumeric"))


_AMOUNT = r"regexp_full_match(regexp_replace({0}, '[.,]', '', 'g'), '(\(([-−]?[0-9]+( *%)?)\)|[-−]?[0-9]+( *%)?)') "


@query("amount_tokens", f"""{TOKENS}, s AS (SELECT *, regexp_replace(token, '\\$|%|USD|EUR|€|-|_|−', '0') AS swapped FROM tokens)
SELECT token, n, {_AMOUNT.format("token")} AS amount, {type_sql("token")} = 'NUMERIC' OR {type_sql("swapped")} = 'NUMERIC' AS representation, token IN ('$', '€') AS incomplete FROM s""")
def amount_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("token", "n", T.is_amount_or_percentage("token").alias("amount"), T.is_amount_representation("token").alias("representation"), T.is_semantically_incomplete("token").alias("incomplete"))


def _index_sql(c: str) -> str:
    cut = f"regexp_replace({c}, '[.,)\\]]+$', '')"
    index = f"regexp_replace({cut}, '^[(\\[]', '')"
    ok = f"({cut} <> '' AND NOT regexp_matches({cut}, '[.,)\\]]') AND ((length({index}) <= 3 AND regexp_full_match({index}, '[A-Z]+|[a-z]+|[0-9]+')) OR {roman_sql(index)} OR regexp_full_match({index}, '[■-◿]')))"
    return f"CASE WHEN regexp_matches({c}, '[.,)\\]]') THEN {ok} ELSE regexp_full_match(trim({c}), '[■-◿]') END"


@query("bullet_index_tokens", f"{TOKENS} SELECT token, n, regexp_full_match(token, '[■-◿]') AS bullet, {_index_sql('token')} AS only_index FROM tokens")
def bullet_index_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("token", "n", T.is_bullet("token").alias("bullet"), T.contains_only_index("token").alias("only_index"))


@query("case_class_tokens", f"{TOKENS} SELECT token, n, regexp_matches(token, '\\p{{L}}') AND NOT regexp_matches(token, '\\p{{Ll}}') AS upper, regexp_matches(token, '\\p{{L}}') AND NOT regexp_matches(token, '\\p{{Lu}}') AS lower FROM tokens")
def case_class_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("token", "n", T.is_upper_case("token").alias("upper"), T.is_lower_case("token").alias("lower"))


_PAGENO = f"len(list_filter(pp, lambda p: NOT {any_number_sql('p')} AND length(p) <> 1 AND NOT regexp_matches(p, '[a-zA-Z]'))) = 0 AND {any_number_sql('pp[len(pp)]')}"


def page_number_sql(c: str) -> str:
    return "(" + _PAGENO.replace("pp", f"(list_transform(string_split(regexp_replace({c}, '-+$', ''), '-'), lambda x: trim(x)))") + ")"


@query("page_number_tokens", f"""{TOKENS}, s AS (SELECT token, n, list_transform(string_split(regexp_replace(token, '-+$', ''), '-'), lambda x: trim(x)) AS pp FROM tokens)
SELECT token, n, {_PAGENO} AS page_number FROM s""")
def page_number_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("token", "n", T.is_page_number("token").alias("page_number"))


# --- lines


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return S.layout_lines(_docs(spark, d)).select("doc_id", "line_no", F.trim("text").alias("text"))


LINES = f"WITH {S.LINES_SQL}, t AS (SELECT doc_id, line_no, trim(text) AS text FROM lines)"
_REST = "regexp_replace(substr(text, instr(left(text, -1), '.') + 1, length(text) - 1 - instr(left(text, -1), '.')), '\\s+$', '')"


def last_line_sql() -> str:
    return f"(text[-1] = '.' AND (instr(left(text, -1), '.') = 0 OR regexp_matches({_REST}, '\\s')))"


@query("line_semantics", f"""{LINES} SELECT doc_id, line_no, regexp_matches(text, '^((?s:.*\\s))?(?i:net|total|subtotal|estimated)((?s:\\s.*))?:?$') AS total,
  text[-1] IN (':', ',') OR (regexp_matches(text, '[0-9]') AND text[-1] = '.') AS connected, {last_line_sql()} AS last_line, regexp_matches(text, '[^\\p{{Pd}}].*\\p{{Pd}}$') AS dash, regexp_matches(text, ':$|^\\(.{{1,4}}\\)$|^-$') AS unique_cell FROM t""")
def line_semantics(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line_no", T.means_total("text").alias("total"), T.can_be_connected("text").alias("connected"), T.is_last_line_of_paragraph("text").alias("last_line"), T.is_dash_wrapped("text").alias("dash"), T.is_unique_cell("text").alias("unique_cell"))


@query("header_candidates", f"""{LINES}, g AS (SELECT doc_id, line_no // 3 AS part, list(text ORDER BY line_no) AS a FROM t GROUP BY ALL), x AS (SELECT *, a[1] AS text FROM g)
SELECT doc_id, part, CASE WHEN len(a) = 1 THEN regexp_matches(text, '[a-zA-Z]') AND NOT {last_line_sql()} ELSE len(list_filter(a[2:], lambda y: NOT regexp_matches(y, '[a-zA-Z]'))) = 0 END AS header FROM x""")
def header_candidates(spark: SparkSession, d: str) -> DataFrame:
    g = _lines(spark, d).groupBy("doc_id", F.floor(F.col("line_no") / 3).cast("long").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("a"))
    return g.select("doc_id", "part", T.can_be_header("a").alias("header"))


@query("invariant_lines", f"""{LINES}, m AS (SELECT doc_id, line_no, {mask_sql("text")} AS k FROM t)
SELECT a.doc_id, a.line_no FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.line_no = a.line_no + 1 WHERE a.k = b.k""")
def invariant_lines(spark: SparkSession, d: str) -> DataFrame:
    a = S.line_pairs(_docs(spark, d)).select("doc_id", "line_no", F.trim("text").alias("text"), F.trim("after").alias("after"))
    return a.where(T.without_numerals("text") == T.without_numerals("after")).where(T.means_same_but_numbers("text", "after")).select("doc_id", "line_no")


@query("repeated_lines_across_pages", f"""{WITH}, m AS (SELECT doc_id, page_no, elem_idx, "left", top, height, {mask_sql("text")} AS k FROM elements)
SELECT a.doc_id, a.page_no, a.elem_idx, min(b.elem_idx) AS next_idx FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.page_no = a.page_no + 1 AND a.k = b.k AND abs(a."left" - b."left") < 30 AND abs(a.top - b.top) < 30 AND abs(a.height - b.height) < 2 GROUP BY ALL""")
def repeated_lines_across_pages(spark: SparkSession, d: str) -> DataFrame:
    return P.repeated_across_pages(_elements(spark, d))


@query("repeated_lines_within_page", f"""{WITH}, m AS (SELECT *, regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[a-z]') AS bold FROM elements)
SELECT DISTINCT a.doc_id, a.page_no, a.elem_idx FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.page_no = a.page_no AND a.text = b.text AND a.bold = b.bold AND a.elem_idx <> b.elem_idx AND abs(a."left" - b."left") < 30 AND abs(a.height - b.height) < 2""")
def repeated_lines_within_page(spark: SparkSession, d: str) -> DataFrame:
    return P.repeated_within_page(_elements(spark, d))


@query("header_footer_regex", f"""{LINED}, j AS (SELECT doc_id, page_no, line, string_agg(text, chr(9) ORDER BY elem_idx) AS text FROM lined GROUP BY ALL), e AS (SELECT *, max(line) OVER (PARTITION BY doc_id, page_no) AS last, regexp_extract(text, '^\\s*(\\S+)', 1) AS w FROM j)
SELECT doc_id, page_no, line, text, line = 0 AND (regexp_matches(text, '(https?|ftp|file)://[\\w\\-+&@#/%?=~|!:,.;]*[\\w\\-+&@#/%=~|]') OR regexp_matches(text, '^\\s*(?i:date)\\b') OR {date_sql("w")}) AS is_head,
  regexp_matches(text, '(?i)continue[sd]?\\s+on\\s+(the\\s+)?next\\s+page') AS is_foot FROM e WHERE line = 0 OR line = last""")
def header_footer_regex(spark: SparkSession, d: str) -> DataFrame:
    return P.head_and_foot_lines(_elements(spark, d))


@query("line_alignment_class", f"""{LINED}, p AS (SELECT doc_id, page_no, line, arg_min("left", elem_idx) AS l, 612 - arg_max("left" + width, elem_idx) AS r FROM lined GROUP BY ALL)
SELECT doc_id, page_no, line, CASE WHEN l < 45 THEN 'EXTREME_LEFT' WHEN r < 45 THEN 'EXTREME_RIGHT' WHEN l > 2 * r THEN 'RIGHT' WHEN l > 150 AND r > 150 AND abs(r - l) < 0.1 * l THEN 'CENTER' ELSE 'LEFT' END AS alignment FROM p""")
def line_alignment_class(spark: SparkSession, d: str) -> DataFrame:
    return P.line_alignment(_elements(spark, d))


_FROM, _TO = ("".join(x).replace("'", "''") for x in (T._FROM, T._TO))


@query("homoglyph_normalised", f"{LINES} SELECT doc_id, line_no, translate(text, '{_FROM}', '{_TO}') AS plain, trim(regexp_replace(lower(text), '[\\s\\p{{P}}]+', ' ', 'g')) AS place FROM t")
def homoglyph_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line_no", T.normalize_homoglyphs("text").alias("plain"), T.normalize_locational_text("text").alias("place"))


_CUR = "CASE symbol " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CURRENCY.items()) + " END"


@query("currency_and_statements", f"""{LINES}, s AS (SELECT *, nullif(regexp_extract(text, '[{"".join(T.CURRENCY)}]'), '') AS symbol, lower(regexp_extract(text, '(?i)\\([a-z]*\\s?in\\s([a-z]+)\\)', 1)) AS w FROM t)
SELECT doc_id, line_no, symbol, {_CUR} AS name, CASE w WHEN 'hundreds' THEN 100 WHEN 'thousands' THEN 1000 WHEN 'millions' THEN 1000000 ELSE 1 END AS factor,
  CASE WHEN regexp_matches(text, '(?i)(statement|result)s?\\s+of\\s+(operations|income)') THEN 'Income Statement' WHEN regexp_matches(text, '(?i)balance\\s+sheets?') THEN 'Balance Sheet' WHEN regexp_matches(text, '(?i)statements?\\s+of\\s+cash\\s+flows?') THEN 'Cash Flows Statement' END AS statement FROM s""")
def currency_and_statements(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line_no", T.currency_symbol("text").alias("symbol"), T.currency_name(T.currency_symbol("text")).alias("name"), T.multiplicative_factor("text").alias("factor"), T.statement_type("text").alias("statement"))


@query("date_tokens", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 1 AND day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE o_orderdate::DATE END AS parsed FROM orders""")
def date_tokens(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    shown = F.lit(None)
    for k, f in enumerate(["MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "d MMM yyyy", "MMMM d, yyyy", "dd-MMM-yyyy"]):
        shown = F.when(F.col("o_orderkey") % 6 == k, F.date_format("o_orderdate", f)).otherwise(shown)
    return o.select("o_orderkey", T.parsed_date(shown).alias("parsed"))


@query("formats", """SELECT o_orderkey, floor(o_totalprice * 100) / 100 AS floored, '#' || lpad(upper(printf('%x', (o_orderkey * 7919) % 16777216)), 6, '0') AS colour,
  round((((o_orderkey * 7919) % 16777216 >> 16 & 255) * 0.299 + ((o_orderkey * 7919) % 16777216 >> 8 & 255) * 0.587 + ((o_orderkey * 7919) % 16777216 & 255) * 0.114) / 255, 9) AS light,
  replace(replace(replace(replace(o_orderpriority || '<&>' || chr(34), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') AS escaped, regexp_replace(regexp_replace(printf('%.2f', (o_orderkey % 400) / 4), '0+$', ''), '\\.$', '') || 'pt' AS length FROM orders""")
def formats(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority").withColumn("rgb", ((F.col("o_orderkey") * 7919) % 16777216).cast("int"))
    return o.select("o_orderkey", T.floor2("o_totalprice").cast("double").alias("floored"), T.hex_color("rgb").alias("colour"), F.round(T.luminance("rgb"), 9).alias("light"), T.html_escape(F.concat("o_orderpriority", F.lit('<&>"'))).alias("escaped"), T.format_length((F.col("o_orderkey") % 400) / 4).alias("length"))


@query("html_text", f"SELECT page_id AS doc_id, {html.text_sql('html')} AS text FROM pages")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return html.documents(spark.read.parquet(f"{d}/pages.parquet"))
