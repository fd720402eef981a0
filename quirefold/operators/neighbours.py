"""Spatial joins of a page's elements with each other and with its lines and images.

Shadows, visual edges and neighbour lists are one Arrow group a page, so that no pair of elements is ever shuffled, spilled
or broadcast.  Within a page pairs are formed for so many elements at a time that their table has at most ``CELLS`` places,
against those that the range along the page leaves: memory does not grow with the square of a tall page.

Defined results: elements without a page or document have no neighbours; a null edge meets nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from ..functions import geometry as G
from .lines import same_line_sql

KEY = ["doc_id", "page_no"]
REACH = G.REACH
BOX = ["elem_idx", "top", "left", "width", "height"]


def _band(c: Column | str) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / REACH)


#: Places of a table of pairs that is held at once.
CELLS = 1 << 20
NONE = -1


class _Page:
    """The boxes of a page as arrays; nulls are NaN, which no comparison holds for."""

    def __init__(self, table: pa.Table) -> None:
        num = lambda c: table.column(c).to_numpy().astype(float)
        self.idx = table.column("elem_idx").to_numpy()
        self.top, self.left, self.width, self.height = (num(c) for c in BOX[1:])
        self.bottom, self.right = self.top + self.height, self.left + self.width
        self.spans = {c: num(c) for c in ("vis_left", "vis_right", "vis_top", "vis_bottom") if c in table.column_names}

    def pairs(self, cond: Callable, axis: tuple, along: np.ndarray, reach: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(a, c): pairs that fulfil ``cond``, c in order of ``axis`` within each a; c's ``along`` lies in a's ``reach``."""
        lo, hi = reach
        by = np.argsort(along, kind="stable")
        by = by[~np.isnan(along[by])]
        ends = along[by]
        every = np.argsort(lo, kind="stable")
        every = every[~np.isnan(lo[every]) & ~np.isnan(hi[every])]
        k = 0
        while k < len(every):
            # as many as the table has room for: fewer where more lies in reach
            take = min(len(every) - k, max(CELLS // max(len(by), 1), 1024))
            while True:
                a = every[k : k + take]
                c = by[np.searchsorted(ends, lo[a[0]], "left") : np.searchsorted(ends, hi[a].max(), "right")]
                if take == 1 or take * len(c) <= CELLS:
                    break
                take = max(take // 2, 1)
            c = c[np.lexsort([x[c] for x in reversed(axis)])]
            i, j = np.nonzero(cond(a[:, None], c[None, :]))
            yield a[i], c[j]
            k += take


def _meets(lower: np.ndarray, upper: np.ndarray, lo: np.ndarray, hi: np.ndarray, reach: float | None = None) -> np.ndarray:
    """``geometry.intersects`` over arrays."""
    near, far = lower <= lo, upper > lo
    if reach is not None:
        near, far = near & (lower > lo - reach), far & (upper < lo + reach)
    return ((lower >= lo) & (lower < hi)) | (near & far)


def _shared(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> np.ndarray:
    """``geometry.overlap`` over arrays."""
    return np.fmax(np.fmin(a_hi, b_hi) - np.fmax(a_lo, b_lo), 0.0)


def _off_line(p: _Page, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``geometry.same_line`` is not 0."""
    high = lambda x: np.where(np.isnan(p.height[x]), 1.0, p.height[x])
    t1, t2 = p.top[a], p.top[b]
    b1, b2 = t1 + high(a), t2 + high(b)
    shared = np.where((t1 >= t2) & (t1 <= b2), b2 - t1, np.where((t2 >= t1) & (t2 <= b1), b1 - t2, 0.0))
    return ~(shared > 0)


def _off_column(p: _Page, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``geometry.same_column`` is not 0."""
    half = lambda x: np.where(np.isnan(p.width[x]), 1.0, p.width[x] / 2)
    return ~(np.abs(p.left[a] - p.left[b]) <= np.minimum(half(a), half(b)))


def _breaks(a: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of an element's candidates so far are off the line of the one before."""
    first = np.r_[True, a[1:] != a[:-1]]
    total = np.cumsum(off & ~first)
    starts = np.flatnonzero(first)
    return total - np.repeat(total[starts], np.diff(np.r_[starts, len(a)]))


def _best(out: np.ndarray, a: np.ndarray, c: np.ndarray, score: np.ndarray) -> None:
    """Puts in ``out`` the c of highest score of each a, the first of equals."""
    order = np.lexsort((-score, a))
    a, c = a[order], c[order]
    first = np.r_[True, a[1:] != a[:-1]]
    out[a[first]] = c[first]


def _vertical(p: _Page, below: bool) -> np.ndarray:
    out = np.full(len(p.idx), NONE)
    lo, hi = (p.spans.get("vis_left", p.left), p.spans.get("vis_right", p.right)) if {"vis_left", "vis_right"} <= p.spans.keys() else (p.left, p.right)
    y = p.top if below else p.bottom
    near = (lambda a, c: (y[c] > y[a] + G.SEPARATION) & (y[c] < y[a] + REACH)) if below else (lambda a, c: (y[c] > y[a] - REACH) & (y[c] < y[a] - G.SEPARATION))
    for a, c in p.pairs(lambda a, c: near(a, c) & _meets(p.left[c], p.right[c], lo[a], hi[a]), (y if below else -y, p.idx), y, (y, y + REACH) if below else (y - REACH, y)):
        if not len(a):
            continue
        one, two = np.r_[c[:1], c[:-1]], np.r_[c[:2], c[:-2]][: len(c)]
        second = np.r_[False, False, a[2:] == a[:-2]][: len(a)]
        with_c = lambda q: _shared(p.left[q], p.right[q], p.left[c], p.right[c])  # noqa: E731, B023
        q = np.where(second & (with_c(one) == 0) & (with_c(two) > 0), two, one)
        kept = _breaks(a, _off_line(p, q, c)) == 0
        a, c = a[kept], c[kept]
        _best(out, a, c, _shared(p.left[a], p.right[a], p.left[c], p.right[c]))
    return out


def _horizontal(p: _Page, right: bool) -> np.ndarray:
    out = np.full(len(p.idx), NONE)
    beside = (lambda a, c: p.left[c] > p.right[a]) if right else (lambda a, c: p.right[c] < p.left[a])
    cond = lambda a, c: beside(a, c) & _meets(p.top[c], p.bottom[c], p.top[a], p.bottom[a], REACH)
    for a, c in p.pairs(cond, (p.left if right else -p.right, p.idx), p.top, (p.top - REACH, np.fmax(p.bottom, p.top))):
        if not len(a):
            continue
        kept = _breaks(a, _off_column(p, np.r_[c[:1], c[:-1]], c)) == 0
        a, c = a[kept], c[kept]
        _best(out, a, c, _shared(p.top[a], p.bottom[a], p.top[c], p.bottom[c]))
    return out


def _lists(p: _Page, direction: str) -> list[list[int]]:
    vertical = direction in ("below", "above")
    mid, middle = p.left + p.width / 2, p.top + p.height / 2
    if vertical:
        below, centre, lo, hi = direction == "below", mid, p.left, p.right
        y = p.top if below else p.bottom
        near = (lambda a, c: (y[c] > y[a] + G.SEPARATION) & (y[c] < y[a] + REACH)) if below else (lambda a, c: (y[c] > y[a] - REACH) & (y[c] < y[a] - G.SEPARATION))
        cond = lambda a, c: near(a, c) & (centre[c] > p.spans["vis_left"][a]) & (centre[c] < p.spans["vis_right"][a])
        found = p.pairs(cond, (y if below else -y, centre, p.idx), y, (y, y + REACH) if below else (y - REACH, y))
    else:
        right, centre, lo, hi = direction == "right", middle, p.top, p.bottom
        beside = (lambda a, c: p.left[c] > p.right[a]) if right else (lambda a, c: p.right[c] < p.left[a])
        cond = lambda a, c: beside(a, c) & (centre[c] > p.spans["vis_top"][a]) & (centre[c] < p.spans["vis_bottom"][a])
        found = p.pairs(cond, (p.left if right else -p.right, centre, p.idx), centre, (p.spans["vis_top"], p.spans["vis_bottom"]))
    out: list[list[int]] = [[] for _ in p.idx]
    for a, c in found:
        if not len(a):
            continue
        before = np.r_[c[:1], c[:-1]]
        kept = _breaks(a, _off_line(p, before, c) if vertical else _off_column(p, before, c)) < 2
        for i, x in zip(a[kept].tolist(), c[kept].tolist(), strict=True):
            l, h = lo[x], hi[x]
            if not any(lo[t] == l or (h >= lo[t] if lo[t] > l else l <= hi[t]) for t in out[i]):
                out[i].append(x)
    return out


def _null(keys: tuple) -> bool:
    return any(k.as_py() is None for k in keys)


def _by_page(elements: DataFrame, kernel: Callable[[_Page], tuple[np.ndarray, pa.Array]], name: str, kind: object) -> DataFrame:
    """(doc_id, page_no, elem_idx, ``name``): what the kernel gives for the elements it names of each page."""
    fields = {f.name: f for f in elements.schema.fields}
    kept = [c for c in (*BOX, "vis_left", "vis_right", "vis_top", "vis_bottom") if c in fields]
    schema = StructType([*[StructField(c, fields[c].dataType) for c in (*KEY, "elem_idx")], StructField(name, kind)])

    def run(keys: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.slice(0, 0) if _null(keys) else rows
        rows = rows.filter(pc.is_valid(rows.column("elem_idx")))
        which, values = kernel(_Page(rows))
        return rows.select([*KEY, "elem_idx"]).take(which).append_column(name, values)

    return elements.select(*KEY, *kept).groupBy(*KEY).applyInArrow(run, schema)


def _shadow(elements: DataFrame, way: Callable[[_Page, bool], np.ndarray], forward: bool) -> DataFrame:
    kind = elements.schema["elem_idx"].dataType

    def kernel(p: _Page) -> tuple[np.ndarray, pa.Array]:
        s = way(p, forward)
        which = np.flatnonzero(s != NONE)
        return which, pa.array(p.idx[s[which]])

    return _by_page(elements, kernel, "shadow", kind)


def shadow_vertical(elements: DataFrame, below: bool = True) -> DataFrame:
    """(doc_id, page_no, elem_idx, shadow): of the nearest line below or above, the element that overlaps most; ties to the nearest.

    Candidates begin below an element's top, or end above its bottom, within reach, and meet its visual span: ``vis_left``
    and ``vis_right`` where present, else its own sides.  The line is the run of candidates in order of distance in which
    each is on the line of the one before, or of the one before that where only that one stands over it.
    """
    return _shadow(elements, _vertical, below)


def shadow_horizontal(elements: DataFrame, right: bool = True) -> DataFrame:
    """(doc_id, page_no, elem_idx, shadow): of the nearest column beside, the element that shares most height; ties to the nearest."""
    return _shadow(elements, _horizontal, right)


def with_shadow(elements: DataFrame, shadow: DataFrame, name: str) -> DataFrame:
    """Elements with the index, top, left, width and height of a shadow as a struct."""
    other = elements.select(*KEY, F.col("elem_idx").alias("__s"), F.struct(*BOX).alias(name))
    # exploded elements are far larger than the planner thinks: never broadcast
    return elements.join(shadow.withColumnRenamed("shadow", "__s").hint("merge"), [*KEY, "elem_idx"], "left").join(other.hint("merge"), [*KEY, "__s"], "left").drop("__s")


def visual_sides(elements: DataFrame, rules: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Elements with ``vis_left`` and ``vis_right`` and whether a vertical line makes them.

    Each lies halfway to the element beside, at the page's edge without one; a vertical line that crosses the element's
    height, no farther than 2 points into either, takes its place, the nearest first.
    """

    def kernel(p: _Page, lines: pa.Table, alone: bool) -> list[np.ndarray]:
        x, y, length = _lines(lines, "vline")
        y2 = y + length
        none = np.full(len(p.idx), NONE)
        to_left, to_right = (none, none) if alone else (_horizontal(p, False), _horizontal(p, True))
        lo, hi = _of(p.right, to_left), _of(p.left, to_right)
        vl, vr = np.full(len(p.idx), np.nan), np.full(len(p.idx), np.nan)
        for a in _portions(len(p.idx), len(x)):
            t, b, l, r = (v[a][:, None] for v in (p.top, p.bottom, p.left, p.right))
            hit = (((y < t) & (y2 > t)) | ((y > t) & (y < b) & (y2 > b))) & (y > t - REACH) & (y2 < b + REACH)
            vl[a] = _farthest(hit & (x < l + G.BORDER) & (np.isnan(lo[a])[:, None] | (x > lo[a][:, None] - G.BORDER)), x, True)
            vr[a] = _farthest(hit & (x > r - G.BORDER) & (np.isnan(hi[a])[:, None] | (x < hi[a][:, None] + G.BORDER)), x, False)
        left = _first(vl, np.where(lo > 0, _mid(lo, p.left), np.nan), np.zeros(len(lo)))
        right = _first(vr, np.where(hi > 0, _mid(hi, p.right), np.nan), np.full(len(hi), page_width))
        return [left, right, ~np.isnan(vl), ~np.isnan(vr)]

    return _with_lines(elements, rules, kernel, ["vis_left", "vis_right"], ["border_left", "border_right"])


def _lines(lines: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left, top and length of a page's lines of a kind."""
    lines = lines.filter(pc.equal(lines.column("kind"), kind))
    return tuple(lines.column(c).to_numpy().astype(float) for c in ("left", "top", "stretch"))


def _of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of the elements named, NaN where none is."""
    return np.where(at == NONE, np.nan, values[at]) if len(at) else np.zeros(0)


def _portions(n: int, lines: int) -> Iterator[slice]:
    size = max(CELLS // max(lines, 1), 1)
    yield from (slice(k, k + size) for k in range(0, n, size))


def _farthest(hit: np.ndarray, x: np.ndarray, most: bool) -> np.ndarray:
    """The greatest or least ``x`` that is hit, NaN for none."""
    if not hit.shape[1]:
        return np.full(len(hit), np.nan)
    end = np.where(hit, x, -np.inf).max(axis=1) if most else np.where(hit, x, np.inf).min(axis=1)
    return np.where(hit.any(axis=1), end, np.nan)


def _mid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.fmin(a, b) + np.abs(b - a) / 2


def _first(*values: np.ndarray) -> np.ndarray:
    """The first value that is none of NaN."""
    out = values[0]
    for v in values[1:]:
        out = np.where(np.isnan(out), v, out)
    return out


def _with_lines(elements: DataFrame, rules: DataFrame, kernel: Callable, numbers: list[str], flags: list[str]) -> DataFrame:
    """Elements with what the kernel makes of a page and its lines."""
    lines = rules.where("kind IN ('hline', 'vline')").select(*KEY, "kind", F.col("left").cast("double").alias("left"), F.col("top").cast("double").alias("top"), F.col("stretch").cast("double").alias("stretch"))
    names = elements.columns
    schema = StructType([*elements.schema.fields, *[StructField(c, DoubleType()) for c in numbers], *[StructField(c, BooleanType()) for c in flags]])

    def run(keys: tuple, rows: pa.Table, lines: pa.Table) -> pa.Table:
        rows = rows.select(names)
        if _null(keys):
            lines = lines.slice(0, 0)
        values = kernel(_Page(rows), lines, _null(keys))
        for name, v in zip([*numbers, *flags], values, strict=True):
            rows = rows.append_column(name, pa.array(v, from_pandas=True))
        return rows

    return elements.groupBy(*KEY).cogroup(lines.groupBy(*KEY)).applyInArrow(run, schema)


def visual_ends(elements: DataFrame, rules: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Elements with ``vis_top`` and ``vis_bottom`` and whether a horizontal line makes them; else halfway to the shadows above and below."""

    def kernel(p: _Page, lines: pa.Table, alone: bool) -> list[np.ndarray]:
        x, y, length = _lines(lines, "hline")
        x2 = x + length
        none = np.full(len(p.idx), NONE)
        up, down = (none, none) if alone else (_vertical(p, False), _vertical(p, True))
        lo, hi = _first(_of(p.bottom, up), np.zeros(len(up))), _first(_of(p.top, down), np.full(len(down), page_height))
        vt, vb = np.full(len(p.idx), np.nan), np.full(len(p.idx), np.nan)
        for a in _portions(len(p.idx), len(x)):
            t, b, l, r, above, below = (v[a][:, None] for v in (p.top, p.bottom, p.left, p.right, lo, hi))
            spans = ((x < l) & (x2 > l)) | ((x < r) & (x2 > r))
            vt[a] = _farthest(spans & (y > t - REACH) & (y < t) & ((above <= 0) | (y > above)), y, True)
            vb[a] = _farthest(spans & (y > b) & (y < b + REACH) & (y < below), y, False)
        top = _first(vt, np.where(lo > 0, _mid(lo, p.top), np.nan), np.zeros(len(lo)))
        return [top, _first(vb, _mid(hi, p.bottom)), ~np.isnan(vt), ~np.isnan(vb)]

    return _with_lines(elements, rules, kernel, ["vis_top", "vis_bottom"], ["border_top", "border_bottom"])


def neighbour_lists(elements: DataFrame, direction: str) -> DataFrame:
    """(doc_id, page_no, elem_idx, ids): elements ``below``, ``above``, ``left`` or ``right`` on up to two lines, nearest first.

    Candidates are those whose centre lies in the visual band; one that overlaps another already taken is passed over.
    """
    spans = {"vis_left": F.lit(0.0), "vis_right": F.lit(1e9), "vis_top": F.col("top"), "vis_bottom": F.col("top") + F.col("height")}
    e = elements.withColumns({k: v for k, v in spans.items() if k not in elements.columns})

    def kernel(p: _Page) -> tuple[np.ndarray, pa.Array]:
        found = _lists(p, direction)
        which = [i for i, x in enumerate(found) if x]
        return np.array(which, int), pa.array([p.idx[found[i]].tolist() for i in which], pa.list_(pa.int32()))

    return _by_page(e, kernel, "ids", ArrayType(IntegerType()))


def background_images(elements: DataFrame) -> DataFrame:
    """Images in whose box some text begins: a semi-join."""
    i, t = elements.where("kind = 'image'").alias("i"), elements.where("kind IN ('text', 'form', 'inline_block')").alias("t")
    inside = (F.col("t.top") > F.col("i.top")) & (F.col("t.top") < F.col("i.top") + F.col("i.height"))
    side = ((F.col("t.left") >= F.col("i.left")) & (F.col("t.left") < F.col("i.left") + F.col("i.width"))) | ((F.col("i.left") > F.col("t.left")) & (F.col("i.left") < F.col("t.left") + F.col("t.width")))
    same = (F.col("i.doc_id") == F.col("t.doc_id")) & (F.col("i.page_no") == F.col("t.page_no"))
    return i.join(t, same & inside & side, "left_semi")


def within_boxes(elements: DataFrame, boxes: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Elements with ``box_id`` where their top left corner lies in a box (doc_id, page_no, box_id, top, left, width, height)."""
    b = boxes.select(*KEY, "box_id", F.col("top").alias("b_top"), F.col("left").alias("b_left"), F.col("width").alias("b_width"), F.col("height").alias("b_height"))
    inside = G.between_open("top", F.col("b_top") - epsilon, F.col("b_top") + F.col("b_height") + epsilon) & G.between_open("left", F.col("b_left") - epsilon, F.col("b_left") + F.col("b_width") + epsilon)
    return elements.join(b, KEY).where(inside).drop("b_top", "b_left", "b_width", "b_height")


def underlined(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """Elements under whose base, within four tenths of their height, a horizontal line covers their centre: a semi-join."""
    e, h = elements.alias("e"), rules.where("kind = 'hline'").alias("h")
    base, centre = F.col("e.top") + F.col("e.height"), F.col("e.left") + F.col("e.width") / 2
    near = (F.abs(F.col("h.top") - base) <= 0.4 * F.col("e.height")) & (F.col("h.left") <= centre) & (F.col("h.left") + F.col("h.stretch") >= centre)
    return e.join(h, (F.col("e.doc_id") == F.col("h.doc_id")) & (F.col("e.page_no") == F.col("h.page_no")) & near, "left_semi")


def gaps_crossed(lined: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, page_no, line, left_idx, right_idx): gaps between neighbours on a line through which a vertical line runs."""
    w = Window.partitionBy(*KEY, "line").orderBy("left", "elem_idx")
    gaps = lined.select(*KEY, "line", F.col("elem_idx").alias("left_idx"), F.lead("elem_idx").over(w).alias("right_idx"), (F.col("left") + F.col("width")).alias("lo"), F.lead("left").over(w).alias("hi"), (F.col("top") + F.col("height") / 2).alias("y")).where("right_idx IS NOT NULL").alias("g")
    v = rules.where("kind = 'vline'").alias("v")
    cond = (F.col("g.doc_id") == F.col("v.doc_id")) & (F.col("g.page_no") == F.col("v.page_no")) & (F.col("v.left") >= F.col("g.lo")) & (F.col("v.left") <= F.col("g.hi")) & (F.col("v.top") <= F.col("g.y")) & (F.col("v.top") + F.col("v.stretch") >= F.col("g.y"))
    return gaps.join(v, cond, "left_semi").select(*KEY, "line", "left_idx", "right_idx")


def text_over_line(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_top, elem_idx, align_left, align_right): the one text of the nearest line above a rule that lies within its ends."""
    h = rules.where("kind = 'hline'").select(*KEY, F.col("top").alias("y"), F.col("left").alias("x"), (F.col("left") + F.col("stretch")).alias("x2"))
    above = h.join(elements.where("kind = 'text'"), KEY).where((F.col("top") < F.col("y")) & (F.col("top") > F.col("y") - REACH))
    w = Window.partitionBy(*KEY, "y", "x", "x2").orderBy(F.desc("top"), F.desc("left"))
    off = F.when(F.lag("elem_idx").over(w).isNull(), 0).otherwise((G.same_line(F.lag("top").over(w), F.lag("height").over(w), "top", "height") != 0).cast("int"))
    last = above.withColumn("off", off).withColumn("b", F.sum("off").over(w)).where("b = 0").where((F.col("left") >= F.col("x")) & (F.col("left") + F.col("width") <= F.col("x2")))
    return last.groupBy(*KEY, "y", "x", "x2").agg(F.count("*").alias("n"), F.min("elem_idx").alias("elem_idx")).where("n = 1").select(*KEY, F.col("y").alias("line_top"), "elem_idx", F.col("x").alias("align_left"), F.col("x2").alias("align_right"))


def best_overlap(items: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, elem_idx and the ``col`` whose span (lo, hi) an element shares most width with; ties to the first."""
    both = items.join(spans, keys).withColumn("o", G.overlap("left", F.col("left") + F.col("width"), "lo", "hi"))
    return both.where("o > 0").groupBy(*keys, "elem_idx").agg(F.max_by("col", F.struct("o", -F.col("col"))).alias("col"))


def border_flags(elements: DataFrame) -> DataFrame:
    """Elements with visual ends, and borders that are no underline: more than 2 points off the text at its side."""
    above = with_shadow(elements, shadow_vertical(elements, False), "__a")
    a_bottom = F.col("__a.top") + F.col("__a.height")
    return above.withColumns({
        "frame_bottom": F.col("border_bottom") & (F.abs(F.col("top") + F.col("height") - F.col("vis_bottom")) > 2),
        "frame_top": F.col("border_top") & (F.col("__a").isNull() | (F.abs(a_bottom - F.col("vis_top")) > 2)),
    }).drop("__a")


def shadow_sql(direction: str) -> str:
    """The common table expression ``shadow`` (doc_id, elem_idx, shadow) over ``elements``, in DuckDB's SQL."""
    meets_x = 'c."left" < a."left" + a.width AND c."left" + c.width > a."left"'
    meets_x = f'((c."left" >= a."left" AND c."left" < a."left" + a.width) OR (c."left" <= a."left" AND c."left" + c.width > a."left"))'
    meets_y = f"((c.top >= a.top AND c.top < a.top + a.height) OR (c.top > a.top - {REACH} AND c.top <= a.top AND c.top + c.height > a.top AND c.top + c.height < a.top + {REACH}))"
    cond, axis = {
        "below": (f"c.top > a.top + 1 AND c.top < a.top + {REACH} AND {meets_x}", "c.top"),
        "above": (f"c.top + c.height < a.top + a.height - 1 AND c.top + c.height > a.top + a.height - {REACH} AND {meets_x}", "-(c.top + c.height)"),
        "right": (f'c."left" > a."left" + a.width AND {meets_y}', 'c."left"'),
        "left": (f'c."left" + c.width < a."left" AND {meets_y}', '-(c."left" + c.width)'),
    }[direction]
    if direction in ("below", "above"):
        over = lambda k: f"greatest(least(l{k} + w{k}, \"left\" + width) - greatest(l{k}, \"left\"), 0)"
        pick = lambda c: f"CASE WHEN t2 IS NOT NULL AND {over(1)} = 0 AND {over(2)} > 0 THEN {c}2 ELSE {c}1 END"
        off = f"NOT {same_line_sql('(' + pick('t') + ')', '(' + pick('h') + ')', 'top', 'height')}"
        score = 'greatest(least(al + aw, "left" + width) - greatest(al, "left"), 0)'
    else:
        off = 'abs(l1 - "left") > least(w1, width) / 2'
        score = "greatest(least(atop + ah, top + height) - greatest(atop, top), 0)"
    return f"""
pairs AS (
  SELECT a.doc_id, a.elem_idx AS a_idx, a.top AS atop, a.height AS ah, a."left" AS al, a.width AS aw, c.elem_idx, c.top, c."left", c.width, c.height, {axis} AS axis
  FROM elements a JOIN elements c ON a.doc_id = c.doc_id AND {cond}),
looked AS (
  SELECT *, lag(top) OVER w AS t1, lag(height) OVER w AS h1, lag("left") OVER w AS l1, lag(width) OVER w AS w1, lag(top, 2) OVER w AS t2, lag(height, 2) OVER w AS h2, lag("left", 2) OVER w AS l2, lag(width, 2) OVER w AS w2, row_number() OVER w AS k
  FROM pairs WINDOW w AS (PARTITION BY doc_id, a_idx ORDER BY axis, elem_idx)),
runs AS (SELECT *, sum(CASE WHEN k > 1 AND {off} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, a_idx ORDER BY axis, elem_idx) AS breaks FROM looked),
shadow AS (SELECT doc_id, a_idx AS elem_idx, arg_max(elem_idx, {score} * 100000 - k) AS shadow FROM runs WHERE breaks = 0 GROUP BY ALL)"""
