"""Headers, footers and content of the pages of a document.

Only what can be a header or footer matters: each page's elements from its edge inwards to the first that lies beyond 15 %
of its height.  These are found, described and compared with the rest of their page by windows and an equi-join; the few
that remain go, a document a group, through the rules that depend on order.

Defined results: a document of one page has neither header nor footer, but by its first line if ``regex``; null texts count
as empty and null sizes as 0; ties go by ``elem_idx``; a form ends the search; elements of other kinds than text, image and
form are content; other columns are not read.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import Options
from . import pages as P

RATIO, EXTREME, SPACE, PER_LINE, CLUSTER, VARIES, APART, TABULAR, OFFSET = 0.15, 0.1, 0.1, 3, 2, 0.2, 2.0, 0.2, 2.0
SIGN = r"[!-/:-@\[-`{-~]"
_SOLID = "kind IN ('text', 'form', 'image', 'inline_block')"


def _alignment(line: list[dict], width: float) -> str:
    left, right = line[0]["left"], width - line[-1]["left"] - line[-1]["width"]
    if left < 45:
        return "EXTREME_LEFT"
    if right < 45:
        return "EXTREME_RIGHT"
    if left > 2 * right:
        return "RIGHT"
    return "CENTER" if left > 150 and right > 150 and abs(right / left - 1) < 0.1 else "LEFT"


def _same(a: dict, b: dict) -> bool:
    """Whether two elements stand on one line."""
    t1, b1, t2, b2 = a["top"], a["top"] + a["height"], b["top"], b["top"] + b["height"]
    shared = b2 - t1 if t2 <= t1 <= b2 else b1 - t2 if t1 <= t2 <= b1 else 0.0
    return shared > 0


def _between(first: dict, second: dict, footer: bool) -> float:
    a, b = (second, first) if footer else (first, second)
    return b["top"] - a["top"] - a["height"]


def candidates(page: list[dict], height: float, width: float, footer: bool, numbered: bool = False, boxed: bool = False) -> list[dict]:
    """Elements from the page's edge inwards (``page`` in this order) that may be its header or footer."""
    limit, extreme = (height * (1 - RATIO), height * (1 - EXTREME)) if footer else (height * RATIO, height * EXTREME)
    found: list[dict] = []
    line: list[dict] = []
    before: list[dict] | None = None
    gap, sizes, beyond, ruled, edge, outermost = float(2**31 - 1), [], None, False, 0.0 if footer else height, False
    for e in page:
        if e["kind"] == "form":
            break
        if not e["solid"]:
            ruled = True
            continue
        if line and not _same(line[-1], e):
            if ruled:
                beyond = e
                break
            gap = _between(line[-1], e, footer)
            if gap >= APART * e["height"]:
                sizes.append(len(found))
            if before is None:
                if line[-1]["top"] > extreme if footer else line[-1]["top"] < extreme:
                    sizes.append(len(found))
                    outermost = True
            elif (_alignment(before, width) != _alignment(line, width) or (footer and sum(x["number"] for x in before) == 1)) and (not sizes or len(found) - len(line) >= sizes[-1]):
                sizes.append(len(found) - len(line))
            before, line = line, []
        elif sum(not x["sign"] for x in line) == PER_LINE:
            found = found[: len(found) - len(line)]
            break
        line.append(e)
        end = e["top"] if footer else e["top"] + e["height"]
        if end < max(edge - height * SPACE, limit) if footer else end > min(edge + height * SPACE, limit):
            beyond = e
            break
        found.append(e)
        edge, ruled = end, False
    at = next((k for k, e in enumerate(found) if e["page_number"]), -1) if numbered and footer else -1
    if found and beyond is not None:
        # a paragraph that goes on beyond the limit is none
        last = _between(found[-1], beyond, footer)
        if last < APART * beyond["height"] and gap != 0 and abs(last - gap) / gap < VARIES:
            found = found[: sizes.pop()] if sizes else []
    sizes.append(len(found))
    for i in range(2 if outermost else 1, len(sizes)):
        if sizes[i] - sizes[i - 1] > CLUSTER:
            return found[: max(at + 1, _noted(found, footer), sizes[i - 1])]
    box = found[-1].get("box") if found and boxed else None
    if box is not None and found[-1]["box_height"] < TABULAR * height:
        for e in page[page.index(found[-1]) + 1 :]:
            if e["solid"] and e.get("box") != box:
                break
            if e["solid"]:
                found.append(e)
    return found


def _noted(found: list[dict], footer: bool) -> int:
    """Elements up to a note that the page goes on, which makes a footer by itself."""
    return next((k + 1 for k, e in enumerate(found) if e["noted"]), 0) if footer else 0


def common(a: list[dict], b: list[dict]) -> int:
    """How many elements of a page's candidates the next page has too: each takes its first likeness not taken yet, whole lines only."""
    left, hits = list(enumerate(b)), []
    for x in a:
        found = next((k for k, (_, y) in enumerate(left) if abs(x["left"] - y["left"]) < P.NEAR_LEFT and abs(x["top"] - y["top"]) < P.NEAR_TOP and abs(x["height"] - y["height"]) < P.NEAR_HEIGHT and x["mask"] == y["mask"]), None)
        if found is None:
            break
        hits.append(left.pop(found)[0])
    hits.sort()
    n = next((k for k in range(1, len(hits)) if hits[k] != hits[k - 1] + 1), len(hits))
    if n < len(a):
        while n > 0 and _same(a[n], a[n - 1]):
            n -= 1
    return n


def repeated(found: list[dict], n: int) -> int:
    """Elements of the innermost lines of the first ``n`` that the page's own content repeats; a line of one element ends them."""
    lines: list[list[dict]] = []
    for e in found[:n]:
        if lines and _same(lines[-1][-1], e):
            lines[-1].append(e)
        else:
            lines.append([e])
    total = 0
    for line in reversed(lines):
        if len(line) < 2 or any(e["kind"] != "text" or e["again"] is None or e["again"] <= found[n - 1]["place"] for e in line):
            break
        total += len(line)
    return total


def sizes_of(pages: list[list[dict]], footer: bool, regex: bool) -> list[int]:
    """How many candidates of each page are its header or footer."""
    if len(pages) < 2 and not regex:
        return [0] * len(pages)
    out, shared, fresh = [], [], True
    for a, b in zip(pages, pages[1:], strict=False):
        n = common(a, b)
        prior = 0 if fresh else shared[-1]
        out.append(max(n, prior, _noted(a, footer)))
        fresh = prior > n
        shared.append(n)
    last = pages[-1]
    n = shared[-1] if shared else 0
    if not shared and regex and last and last[0]["line_head"]:
        n = next((k for k in range(1, len(last)) if not _same(last[0], last[k])), len(last))
    out.append(max(n, _noted(last, footer)))
    return [n - repeated(found, n) if n else 0 for found, n in zip(pages, out, strict=True)]


def _edge(rows: DataFrame, height: float, footer: bool, boxed: bool) -> DataFrame:
    """The rows from one edge of each page to the first solid one beyond the limit, with ``place`` from that edge."""
    w = Window.partitionBy("doc_id", "page_no").orderBy(F.desc("elem_idx") if footer else "elem_idx")
    out = F.col("solid") & ((F.col("top") < height * (1 - RATIO)) if footer else (F.col("top") + F.col("height") > height * RATIO))
    near = rows.withColumns({"place": F.row_number().over(w), "__out": F.coalesce(F.count_if(out).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    keep = F.col("__out") == 0
    if boxed:  # and what stands in a box that such a row stands in
        keep = keep | F.coalesce(F.max(keep.cast("int")).over(Window.partitionBy("doc_id", "page_no", "box")) == 1, F.lit(False)) & F.col("box").isNotNull()
    return near.where(keep).drop("__out")


def _described(rows: DataFrame, all_rows: DataFrame, footer: bool) -> DataFrame:
    """Rows with what the rules ask of their texts, and ``again``: the farthest place of a likeness in the page."""
    w = Window.partitionBy("doc_id", "page_no").orderBy(F.desc("elem_idx") if footer else "elem_idx")
    styles = F.array_join(F.array_sort(F.array_distinct(F.coalesce("styles", F.array().cast("array<string>")))), ",")
    other = all_rows.withColumn("p2", F.row_number().over(w)).where("solid")
    other = other.select("doc_id", "page_no", "text", styles.alias("__s"), F.col("left").alias("l2"), F.col("height").alias("h2"), "p2")
    mine = rows.where("kind = 'text' AND text <> ''").select("doc_id", "page_no", "elem_idx", "place", "text", styles.alias("__s"), "left", "height")
    like = (F.abs(F.col("left") - F.col("l2")) < P.NEAR_LEFT) & (F.abs(F.col("height") - F.col("h2")) < P.NEAR_HEIGHT) & (F.col("p2") > F.col("place"))
    again = mine.join(other.hint("merge"), ["doc_id", "page_no", "text", "__s"]).where(like).groupBy("doc_id", "page_no", "elem_idx").agg(F.max("p2").alias("again"))
    text = F.col("text")
    said = {"number": T.is_number_in_any_system(text), "page_number": T.is_page_number(text), "sign": T.matches(text, SIGN), "noted": T.matches(text, "(?i)continues on next page"), "mask": F.xxhash64(T.masked_numbers(text))}
    return rows.withColumns({k: F.coalesce(c, F.lit(False)) if k != "mask" else c for k, c in said.items()}).join(again.hint("merge"), ["doc_id", "page_no", "elem_idx"], "left")


def partitions(elements: DataFrame, page_height: float = 792.0, page_width: float = 612.0, across: bool = False, exclude: bool = True, regex: bool = False, options: Options | None = None) -> DataFrame:
    """(doc_id, page_no, elem_idx, partition, part): HEADER, CONTENT or FOOTER, and the number of the partition in its document.

    With ``across`` the content of all pages is one partition, the first; without ``exclude`` all elements are content.
    Columns ``box`` and ``box_height``, where there are any, extend headers and footers over small boxed tables.
    """
    o = options or Options(is_page_numbered_doc=True)
    if o.disable_header_footer_detection:
        exclude = False
    base = elements.select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.col("elem_idx").cast("int").alias("elem_idx"))
    found = base.withColumn("partition", F.lit("CONTENT"))
    if exclude:
        boxed = {"box", "box_height"} <= set(elements.columns)
        n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in elements.columns else F.lit(0.0).alias(c)
        styles = F.col("styles") if "styles" in elements.columns else F.array().cast("array<string>")
        kind = F.col("kind") if "kind" in elements.columns else F.lit("text")
        rows = elements.select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.col("elem_idx").cast("int").alias("elem_idx"), kind.alias("kind"), n("top"), n("left"), n("width"), n("height"), F.coalesce("text", F.lit("")).alias("text"), styles.alias("styles"), *([F.col("box"), F.col("box_height")] if boxed else [])).withColumn("solid", F.expr(_SOLID))
        sides = [_described(_edge(rows, page_height, foot, boxed), rows, foot).withColumn("footer", F.lit(foot)) for foot in (False, True)]
        heads = P.head_and_foot_lines(elements).where("is_head AND line = 0").select("doc_id", "page_no", F.lit(True).alias("line_head")) if regex else None

        doc_type = elements.schema["doc_id"].dataType.simpleString()

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            out: list[tuple] = []
            all_rows = sorted((e for e in rows.to_pylist() if e["page_no"] is not None), key=lambda e: (e["footer"], e["page_no"], e["place"]))
            for foot, side in groupby(all_rows, key=lambda e: e["footer"]):
                pages = [candidates(list(g), page_height, page_width, foot, o.is_page_numbered_doc, boxed) for _, g in groupby(side, key=lambda e: e["page_no"])]
                for page, n in zip(pages, sizes_of(pages, foot, regex), strict=True):
                    out += [(e["page_no"], e["elem_idx"], "FOOTER" if foot else "HEADER") for e in page[:n]]
            page_no, elem_idx, side = zip(*out, strict=True) if out else ((), (), ())
            return pa.table({"doc_id": pa.array([key[0].as_py()] * len(out), rows.schema.field("doc_id").type), "page_no": pa.array(page_no, pa.int32()), "elem_idx": pa.array(elem_idx, pa.int32()), "partition": pa.array(side, pa.string())})

        both = sides[0].unionByName(sides[1])
        both = both.join(heads, ["doc_id", "page_no"], "left").fillna(False, ["line_head"]) if regex else both.withColumn("line_head", F.lit(False))
        # an element that two edges claim is a header
        marks = both.drop("text", "styles").groupBy("doc_id").applyInArrow(run, f"doc_id {doc_type}, page_no int, elem_idx int, partition string").groupBy("doc_id", "page_no", "elem_idx").agg(F.max("partition").alias("partition"))
        found = base.join(marks.hint("merge"), ["doc_id", "page_no", "elem_idx"], "left").withColumn("partition", F.coalesce("partition", F.lit("CONTENT")))
    return found.withColumn("part", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy(*_rank(across))) - 1).cast("int"))


def _rank(across: bool) -> list[Column]:
    """Order of partitions in a document: by page, a header first; content of all pages before all else if it is one."""
    side = F.when(F.col("partition") == "HEADER", 0).when(F.col("partition") == "CONTENT", 1).otherwise(2)
    if not across:
        return [F.col("page_no"), side]
    content = F.col("partition") == "CONTENT"
    return [F.when(content, -1).otherwise(F.col("page_no")), F.when(content, 0).otherwise(side)]


def bounds(elements: DataFrame, found: DataFrame, page_height: float = 792.0) -> DataFrame:
    """(doc_id, part, partition, first_page, last_page, top, bottom) of each partition, 2 points beyond its header or before its footer."""
    e = found.join(elements.select("doc_id", "page_no", "elem_idx", "top", F.coalesce("height", F.lit(0.0)).alias("height")), ["doc_id", "page_no", "elem_idx"])
    per = e.groupBy("doc_id", "part", "partition").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.max_by(F.col("top") + F.col("height"), "elem_idx").alias("end"), F.min_by("top", "elem_idx").alias("begin"))
    w = Window.partitionBy("doc_id", "last_page")
    of = lambda name, c: F.max(F.when(F.col("partition") == name, c)).over(w)
    whole = per.withColumns({"h": of("HEADER", F.col("end") + OFFSET), "f": of("FOOTER", F.col("begin") - OFFSET)})
    one = (F.col("partition") == "CONTENT") & (F.col("first_page") == F.col("last_page"))
    top = F.when(F.col("partition") == "FOOTER", F.col("f")).when(one, F.coalesce("h", F.lit(0.0))).otherwise(0.0)
    bottom = F.when(F.col("partition") == "HEADER", F.col("h")).when(one, F.coalesce("f", F.lit(page_height))).otherwise(page_height)
    return whole.select("doc_id", "part", "partition", "first_page", "last_page", top.alias("top"), bottom.alias("bottom"))
