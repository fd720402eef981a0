"""Plain text as positioned elements: fixed pitch, wrapped at 80 characters, 24 lines a page.

Everything is computed from one text after the other, without a shuffle, in one Arrow pass whose batches are bounded.  A source line after the first on its page stands 18
points lower than its pitch alone would place it, so paragraphs show.  Two or more spaces, or a tab, part segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import BLANKS, SEPARATOR_RE

WRAP, PER_PAGE, PITCH, HEIGHT, CHAR, LEFT, TOP, LEAD, PAGE_WIDTH, PAGE_HEIGHT = 80, 24, 12, 10, 6, 72, 36, 18, 612, 792
#: Rows that are passed on at once.
ROWS = 20000
_SEGMENT = re.compile("[^ ]+(?: [^ ]+)*")
_WORD = re.compile(f"[0-9]+|[^0-9{SEPARATOR_RE}]+|[{SEPARATOR_RE}]+")
_separates = cache(re.compile(f"[{SEPARATOR_RE}]").match)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """Source line and text of at most 80 characters, blank ones left out."""
    src = 0
    for line in text.replace("\r", "").replace("\t", "  ").split("\n"):
        if not line.strip(" "):
            continue
        if len(line) <= WRAP:
            yield src, line
        else:
            for at in range(0, len(line), WRAP):
                if (piece := line[at : at + WRAP]).strip(" "):
                    yield src, piece
        src += 1


def _laid(text: str) -> Iterator[tuple[int, int, int, float, str]]:
    """Line, page, source line, top and text of each line of a layout."""
    head = 0
    for line, (src, piece) in enumerate(_pieces(text)):
        page, m = divmod(line, PER_PAGE)
        if m == 0:
            head = src
        yield line, page, src, float(TOP + PITCH * m + LEAD * (src - head)), piece


def _spread(docs: DataFrame, columns: list[StructField], rows_of) -> DataFrame:  # noqa: ANN001
    """(doc_id, columns): the rows that each text gives, in one pass over the texts; null texts give none."""
    source = docs.where("text IS NOT NULL").select("doc_id", "text")
    schema = StructType([source.schema["doc_id"], *columns])
    kinds = {IntegerType(): pa.int32(), LongType(): pa.int64(), DoubleType(): pa.float64(), StringType(): pa.string()}
    types = [kinds[c.dataType] for c in columns]

    def put(ids: pa.Array, counts: list[int], rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array([k for k, n in enumerate(counts) for _ in range(n)], pa.int32())
        return pa.RecordBatch.from_arrays([ids.take(at), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]], names=schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, rows, first = batch.column(0), [], [], 0
            for k, text in enumerate(batch.column(1)):
                before = len(rows)
                for row in rows_of(text.as_py()):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        # a long text is passed on in parts
                        yield put(ids.slice(first), [*counts, len(rows) - before], rows)
                        counts, rows, first, before = [], [], k, 0
                counts.append(len(rows) - before)
            if rows:
                yield put(ids.slice(first), counts, rows)

    return source.mapInArrow(run, schema)


def layout_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, page_no, src, top, text): a row for each line of the layout."""
    columns = [StructField("line_no", IntegerType()), StructField("page_no", IntegerType()), StructField("src", IntegerType()), StructField("top", DoubleType()), StructField("text", StringType())]
    return _spread(docs, columns, _laid)


def _followed(text: str) -> Iterator[tuple[int, str, str]]:
    """Each line but the last of a layout, and the one after it."""
    last = None
    for line, (_, piece) in enumerate(_pieces(text)):
        if last is not None:
            yield line - 1, last, piece
        last = piece


def line_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text, after): lines of the layout with the text of the next one; the last has none, and gives no row."""
    return _spread(docs, [StructField("line_no", IntegerType()), StructField("text", StringType()), StructField("after", StringType())], _followed)


def _words(ids: pa.Array, at: list[int], lines: list[int], counts: list[int], found: list[str], names: list[str]) -> pa.RecordBatch:
    """The runs ``found`` in lines, of which ``counts`` are in each, as words with their places; blank ones are left out."""
    runs = pa.array(found, pa.string())
    n, counts = pc.utf8_length(runs).to_numpy(), np.array(counts)
    begin = np.cumsum(n) - n
    begin -= np.repeat(begin[np.cumsum(counts) - counts], counts)
    cut = pc.utf8_ltrim(runs, characters=BLANKS)
    index = pa.array(begin.astype("int64") + n - pc.utf8_length(cut).to_numpy())
    word = pc.utf8_rtrim(cut, characters=BLANKS)
    is_word = pa.array([not _separates(x[0]) for x in found], pa.bool_())
    columns = [ids.take(pa.array(np.repeat(np.array(at, "int32"), counts))), pa.array(np.repeat(np.array(lines, "int32"), counts)), index, word, is_word]
    return pa.RecordBatch.from_arrays(columns, names=names).filter(pc.not_equal(word, ""))


def layout_words(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, index, word, is_word): words of the layout's lines and the separators between them, as ``split_indexed_words`` with numbers.

    They are cut as the text is laid out, and what a run of characters is, where it begins and what is blank of it is
    found for all runs of a batch at once.
    """
    source = docs.where("text IS NOT NULL").select("doc_id", "text")
    schema = StructType([source.schema["doc_id"], StructField("line_no", IntegerType()), StructField("index", LongType()), StructField("word", StringType()), StructField("is_word", BooleanType())])
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, lines, counts, found = batch.column(0), [], [], [], []
            for k, text in enumerate(batch.column(1)):
                for line, (_, piece) in enumerate(_pieces(text.as_py())):
                    runs = _WORD.findall(piece)
                    at.append(k)
                    lines.append(line)
                    counts.append(len(runs))
                    found += runs
                    if len(found) >= ROWS:
                        # a long text is passed on in parts
                        yield _words(ids, at, lines, counts, found, names)
                        at, lines, counts, found = [], [], [], []
            if found:
                yield _words(ids, at, lines, counts, found, names)

    return source.mapInArrow(run, schema)


def _segments(text: str) -> Iterator[tuple[int, int, int, float, float, float, str]]:
    """Place of each segment of a text, and what it says."""
    for line, page, _, top, piece in _laid(text):
        for k, m in enumerate(_SEGMENT.finditer(piece)):
            yield line * WRAP + k, page, line, top, float(LEFT + CHAR * m.start()), float(CHAR * (m.end() - m.start())), m.group()


def text_elements(docs: DataFrame) -> DataFrame:
    """Elements of the layout of (doc_id, text); null texts have none."""
    columns = [StructField("elem_idx", IntegerType()), StructField("page_no", IntegerType()), StructField("line_no", IntegerType()), *[StructField(c, DoubleType()) for c in ("top", "left", "width")], StructField("text", StringType())]
    return _spread(docs, columns, _segments).select(
        "doc_id", "elem_idx", "page_no", F.lit("text").alias("kind"), "top", "left", "width", F.lit(float(HEIGHT)).alias("height"), F.lit(None).cast("double").alias("stretch"), "text", F.lit("Courier").alias("font_family"), F.lit(10.0).alias("font_size"),
        F.when(F.regexp_like("text", F.lit("[A-Z]")) & ~F.regexp_like("text", F.lit("[a-z]")), F.array(F.lit("bold"))).otherwise(F.array().cast("array<string>")).alias("styles"), F.lit(0).alias("rgb"), "line_no",
    )


def pages_of(elements: DataFrame, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> DataFrame:
    """(doc_id, page_no, width, height) of every page that holds an element."""
    return elements.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(float(width)).alias("width"), F.lit(float(height)).alias("height"))


LINES_SQL = f"""
source AS (SELECT doc_id, list_filter(string_split(replace(replace(text, chr(13), ''), chr(9), '  '), chr(10)), lambda s: regexp_matches(s, '[^ ]')) AS ls FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS src FROM source),
wrapped AS (SELECT doc_id, src, j, substr(l, j * {WRAP} + 1, {WRAP}) AS text FROM (SELECT doc_id, l, src, unnest(range(greatest((length(l) - 1) // {WRAP}, 0) + 1)) AS j FROM numbered)),
counted AS (SELECT doc_id, src, text, row_number() OVER (PARTITION BY doc_id ORDER BY src, j) - 1 AS line_no FROM wrapped WHERE regexp_matches(text, '[^ ]')),
lines AS (
  SELECT doc_id, line_no, line_no // {PER_PAGE} AS page_no, src,
    {TOP} + {PITCH} * (line_no % {PER_PAGE}) + {LEAD} * (src - min(src) OVER (PARTITION BY doc_id, line_no // {PER_PAGE})) AS top, text FROM counted)"""
SEGMENTS_SQL = f"""
spots AS (SELECT doc_id, line_no, page_no, top, text, unnest(range(1, length(text) + 1)) AS i FROM lines),
begins AS (
  SELECT doc_id, line_no, page_no, top, text, i, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) AS k FROM spots
  WHERE text[i] <> ' ' AND (i = 1 OR (text[i - 1] = ' ' AND (i = 2 OR text[i - 2] = ' ')))),
ends AS (
  SELECT doc_id, line_no, i, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) AS k FROM spots
  WHERE text[i] <> ' ' AND (i = length(text) OR (text[i + 1] = ' ' AND (i + 1 = length(text) OR text[i + 2] = ' ')))),
elements AS (
  SELECT b.doc_id, b.line_no * {WRAP} + b.k - 1 AS elem_idx, b.line_no, b.page_no, b.top, {LEFT} + {CHAR} * (b.i - 1) AS "left", {CHAR} * (e.i - b.i + 1) AS width, {HEIGHT} AS height, substr(b.text, b.i, e.i - b.i + 1) AS text
  FROM begins b JOIN ends e ON b.doc_id = e.doc_id AND b.line_no = e.line_no AND b.k = e.k)"""
