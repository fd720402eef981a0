"""Layout of whole documents: alignment, spatial context, paragraphs and tables.

What one element gets depends on what earlier ones got, so this runs in element order, document after document of a sorted
partition.  Elements are kept sorted by their top; every search along the page reads a window of that order.  Documents are
independent, so the one shuffle, on ``doc_id``, is the only one.  An Arrow batch holds many documents, and one that is larger
than a batch is put together from several: it alone has to fit in memory.

Defined results: elements of no text, form or image take no part; null tops, widths and heights count as 0; ties go by
``elem_idx``; a document without elements gives no rows; columns that are not read pass out of the result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..functions.geometry import ALIGNMENT, BORDER, REACH, SEPARATION, SMALL
from ..options import Options

CONTEXT = (
    "doc_id bigint, elem_idx int, shadow_above int, shadow_below int, shadow_left int, shadow_right int, vis_top double, vis_bottom double, vis_left double, vis_right double, "
    "border_top boolean, border_bottom boolean, border_left boolean, border_right boolean, align_left double, align_right double, above_ids array<int>, below_ids array<int>, left_ids array<int>, right_ids array<int>, "
    "vg_id int, table_id int, t_row int, t_col int"
)
_NEED = ["doc_id", "elem_idx", "page_no", "kind", "top", "left", "width", "height", "stretch", "text", "font_size", "styles"]
#: Heights that paragraphs and rows may differ by, gaps that they may grow by, gap in heights within an alignment group.
HEIGHT_VARIES, GAP_VARIES, ALIGN_GAP, ROW_VARIES, SLOPE = 0.4, 0.5, 5.0, 0.2, 0.15
ROW_GAP, ROW_GAP_GROWS, FONT_GROWS, JUMP, FIT = 100, 3, 1.4, 0.6, 4.0


NONE, NO_LINES = np.zeros(0), np.zeros((0, 3))
#: Kinds of elements that take part.
BOXES = frozenset(("text", "form", "image", "inline_block"))


def digit_jump(above: list[str], row: list[str]) -> float:
    """How far the share of texts with digits changes from a row to the next."""
    share = lambda r: sum(any("0" <= c <= "9" for c in t) for t in r) / len(r) if r else 0.0
    return abs(share(above) - share(row))


class Sheet:
    """The elements of one document on one page, and what is found out about them."""

    def __init__(self, rows: pd.DataFrame | dict[str, list], width: float = 612.0, height: float | None = None, options: Options | None = None, want: set[str] | None = None) -> None:
        """``rows`` holds the columns of ``_NEED``; of the context only what ``want`` names is sure to be found out (None: all)."""
        rows = {c: rows[c].astype(object).tolist() for c in rows.columns} if isinstance(rows, pd.DataFrame) else rows
        zero = lambda x: 0.0 if x is None or x != x else float(x)
        tops, ids, kinds = [zero(t) for t in rows["top"]], rows["elem_idx"], rows["kind"]
        order = sorted(range(len(ids)), key=list(zip(tops, ids, strict=True)).__getitem__) if _in_disorder(tops, ids) else range(len(ids))
        boxes = [k for k in order if kinds[k] in BOXES]
        num = lambda c: [zero(x) for x in map(rows[c].__getitem__, boxes)]
        self.options, self.n, self.page_width, self.want = options or Options(), len(boxes), width, want
        self.idx, self.kind, self.page = [int(ids[k]) for k in boxes], [kinds[k] for k in boxes], [int(rows["page_no"][k]) for k in boxes]
        self.top, self.left, self.width, self.height = (num(c) for c in ("top", "left", "width", "height"))
        self.bottom, self.right = [t + h for t, h in zip(self.top, self.height, strict=True)], [x + w for x, w in zip(self.left, self.width, strict=True)]
        texts, styles = rows["text"], rows["styles"]
        self.text = ["" if (t := texts[k]) is None or t != t else str(t) for k in boxes]
        self.font, self.bold = num("font_size"), ["bold" in s if isinstance(s := styles[k], list) else s is not None and "bold" in list(s) for k in boxes]
        self.t, self.b, self.l, self.r, self.w, self.h_, self.ids = self.top, self.bottom, self.left, self.right, self.width, self.height, self.idx
        self.centre, self.mid = [x + w / 2 for x, w in zip(self.l, self.w, strict=True)], [t + h / 2 for t, h in zip(self.t, self.h_, strict=True)]
        self.tops, self.tallest = self.t, max(self.h_, default=0.0) if self.n and max(self.h_) > 0 else 0.0
        n = self.n
        falling = [-b for b in self.b]
        self.by_bottom = [c for _, _, c in sorted(zip(falling, self.ids, range(n), strict=True))]
        self.bottoms = [falling[c] for c in self.by_bottom]
        self.orders: dict[str, list[int]] = {}
        lines = lambda k: np.array([[zero(rows[c][i]) for c in ("left", "top", "stretch")] for i in order if kinds[i] == k]).reshape(-1, 3)
        ruled = n < len(ids)
        self.v, self.h = (lines("vline"), lines("hline")) if ruled else (NO_LINES, NO_LINES)
        self.page_bottom = height if height is not None else max(792.0, max(self.bottom, default=0.0))
        self.reading = sorted(range(n), key=self.idx.__getitem__)
        self.align_left, self.align_right = [0.0] * n, [0.0] * n
        self.shadow = {s: [-1] * n for s in ("above", "below", "left", "right")}
        self.vis = {s: [0.0] * n for s in ("top", "bottom", "left", "right")}
        self.ruled = {s: [False] * n for s in ("top", "bottom", "left", "right")}
        self.near: dict[str, list[list[int]]] = {s: [[] for _ in range(n)] for s in ("above", "below", "left", "right") if self.wants(f"{s}_ids")}
        self.group, self.groups = [-1] * n, []
        self.table, self.row, self.col = [-1] * n, [-1] * n, [-1] * n
        self.noise: set[int] = set()

    def wants(self, *columns: str) -> bool:
        return self.want is None or not self.want.isdisjoint(columns)

    def by(self, name: str) -> list[int]:
        """Elements by top, or by falling bottom, and then by their centres."""
        if name not in self.orders:
            first = self.t if name == "top" else [-b for b in self.b]
            self.orders[name] = [c for *_, c in sorted(zip(first, self.centre, self.ids, range(self.n), strict=True))]
        return self.orders[name]

    # --- searches

    def span(self, lo: float, hi: float) -> range:
        """Elements whose top lies strictly between."""
        a = bisect_right(self.tops, lo)
        return range(a, max(bisect_left(self.tops, hi), a))

    def on_line(self, a: int, b: int) -> bool:
        """Whether two elements share height."""
        least = 0.02 if "form" in (self.kind[a], self.kind[b]) else 0.0
        return min(self.b[a], self.b[b]) - max(self.t[a], self.t[b]) > least * min(self.h_[a], self.h_[b])

    def on_column(self, a: int, b: int) -> bool:
        return abs(self.l[a] - self.l[b]) <= min(self.w[a], self.w[b]) / 2

    def meets(self, c: int, lo: float, hi: float) -> bool:
        return lo <= self.l[c] < hi or self.l[c] <= lo < self.r[c]

    def share(self, a: int, b: int) -> float:
        return max(min(self.r[a], self.r[b]) - max(self.l[a], self.l[b]), 0.0)

    def nearest(self, found: Iterable[int], lo: float, hi: float, left: float, right: float) -> int:
        """Of the first line of those that lie within, the one that shares most width with left .. right; -1 if there is none."""
        l, r, t, b, forms = self.l, self.r, self.t, self.b, self.kind
        best, most, last, before = -1, -1.0, -1, -1
        for c in found:
            x, y = l[c], r[c]
            if not (lo <= x < hi or x <= lo < y):
                continue
            if last >= 0:
                q = last
                if before >= 0 and self.share(c, last) == 0 and self.share(c, before) > 0:
                    q = before
                if "form" in (forms[q], forms[c]):
                    if not self.on_line(q, c):
                        break
                elif (b[q] if b[q] < b[c] else b[c]) - (t[q] if t[q] > t[c] else t[c]) <= 0:
                    break
            s = (y if y < right else right) - (x if x > left else left)
            s = s if s > 0 else 0.0
            if s > most:
                best, most = c, s
            before, last = last, c
        return best

    def below(self, top: float, lo: float, hi: float, left: float, right: float) -> int:
        return self.nearest(self.span(top + SEPARATION, top + REACH), lo, hi, left, right)

    def ending(self, by: list[int], ends: list[float], bottom: float) -> Iterator[int]:
        """Elements that end above a bottom, within reach, in an order of falling bottoms (``ends``: their negatives)."""
        for k in range(bisect_right(ends, SEPARATION - bottom), len(by)):
            if self.b[by[k]] <= bottom - REACH:
                return
            if self.t[by[k]] < bottom:
                yield by[k]

    def above(self, bottom: float, lo: float, hi: float, left: float, right: float) -> int:
        return self.nearest(self.ending(self.by_bottom, self.bottoms, bottom), lo, hi, left, right)

    def sides(self, i: int) -> tuple[int, int]:
        """The elements beside one, left and right."""
        t, b, l, r = self.t, self.b, self.l, self.r
        top, end, left, right = t[i], b[i], l[i], r[i]
        before, after = [], []
        # one that begins higher up than the tallest is high cannot reach this one
        for c in self.span(max(top - REACH, top - self.tallest - 1), max(end, top + 1e-9)):
            if t[c] >= top or top < b[c] < top + REACH:
                if l[c] > right:
                    after.append((l[c], self.ids[c], c))
                # not in place of the first: a width below 0 puts one on both sides
                if r[c] < left:
                    before.append((-r[c], self.ids[c], c))
        return self.widest(before, top, end), self.widest(after, top, end)

    def widest(self, found: list[tuple[float, int, int]], top: float, end: float) -> int:
        """Of the first column of candidates, the one that shares most height with top .. end; -1 if there is none."""
        if not found:
            return -1
        found.sort()
        t, b = self.t, self.b
        best, most, last = -1, -1.0, -1
        for _, _, c in found:
            if last >= 0 and not self.on_column(last, c):
                break
            s = (b[c] if b[c] < end else end) - (t[c] if t[c] > top else top)
            s = s if s > 0 else 0.0
            if s > most:
                best, most = c, s
            last = c
        return best

    def beside(self, i: int, right: bool) -> int:
        return self.sides(i)[right]

    # --- alignment

    def find_alignment(self) -> None:
        """Runs of elements under each other that share a left edge, right edge or centre."""
        t, b, l, r, centre, h = self.t, self.b, self.l, self.r, self.centre, self.h_
        for i in self.reading:
            if self.align_right[i] != 0:
                continue
            run, last, left, right, middle = [i], i, l[i], r[i], centre[i]
            lo, hi = left - ALIGNMENT, right + ALIGNMENT
            for c in self.span(t[i] + ALIGNMENT, t[i] + REACH):
                x = l[c]
                if not (lo <= x < hi or x <= lo < r[c]):
                    continue
                if self.align_right[c] != 0 or not (abs(x - left) < ALIGNMENT or abs(r[c] - right) < ALIGNMENT or abs(centre[c] - middle) < ALIGNMENT) or t[c] - b[last] > ALIGN_GAP * h[last]:
                    break
                run.append(c)
                last = c
            if len(run) > 1:
                first, end = min([l[c] for c in run]) - SEPARATION, max([r[c] for c in run]) + SEPARATION
                for c in run:
                    self.align_left[c], self.align_right[c] = first, end

    # --- context

    def find_context(self) -> None:
        """Shadows, visual edges and neighbours of every element, in this order, as each needs those before."""
        left, right, below, above = (self.shadow[s] for s in ("left", "right", "below", "above"))
        ends = self.wants("vis_top", "vis_bottom", "border_top", "border_bottom", "left_ids", "right_ids") or len(self.h) > 0
        over = ends or self.wants("shadow_above")
        for i in self.reading:
            left[i], right[i] = self.sides(i)
            self.side(i)
            lo, hi = self.vis["left"][i], self.vis["right"][i]
            below[i] = self.below(self.t[i], lo, hi, self.l[i], self.r[i])
            if over:
                above[i] = self.above(self.b[i], lo, hi, self.l[i], self.r[i])
            if ends:
                self.end(i)
            for name, near in self.near.items():
                near[i] = self.neighbours(i, name)

    def side(self, i: int) -> None:
        t, b, l, r = self.t[i], self.b[i], self.l[i], self.r[i]
        crossing = NONE
        if len(self.v):
            x, y, y2 = self.v[:, 0], self.v[:, 1], self.v[:, 1] + self.v[:, 2]
            crossing = x[((y > t - REACH) & (y < t) & (y2 > t) & (y2 < t + REACH)) | ((y > t) & (y < b) & (y2 > b) & (y2 < b + REACH))]
        other, mine = self.shadow["left"][i], self.align_left[i]
        edge = aligned = 0.0
        if other >= 0:
            edge, aligned = self.r[other], self.align_right[other]
        theirs = other >= 0 and 0 < aligned < l
        ours = mine > 0 and mine > (edge if other >= 0 else -1)
        self.vis["left"][i] = self.between(mine if ours else l, aligned if theirs else edge, other, theirs, ours, 0.0)
        after, own = self.shadow["right"][i], self.align_right[i]
        far, aligned = self.page_width, 0.0
        if after >= 0:
            far, aligned = self.l[after], self.align_left[after]
        theirs = after >= 0 and aligned > r
        ours = own > 0 and after >= 0 and own < far
        self.vis["right"][i] = self.between(own if ours else r, aligned if theirs else far, after, theirs, ours, self.page_width)
        if len(crossing):
            on = crossing[crossing < l + BORDER]
            on = on[on > edge - BORDER] if other >= 0 else on
            if len(on):
                self.vis["left"][i], self.ruled["left"][i] = float(on.max()), True
            on = crossing[crossing > r - BORDER]
            on = on[on < far + BORDER] if after >= 0 else on
            if len(on):
                self.vis["right"][i], self.ruled["right"][i] = float(on.min()), True

    @staticmethod
    def between(a: float, o: float, other: int, theirs: bool, ours: bool, far: float) -> float:
        """Where an edge is seen between an element's own and the other's: halfway, or on the one that is aligned."""
        if other < 0 or o <= 0:
            return far
        return min(a, o) + abs(a - o) / 2 if theirs == ours else (a if ours else o)

    def end(self, i: int) -> None:
        t, b, l, r = self.t[i], self.b[i], self.l[i], self.r[i]
        a, c = self.shadow["above"][i], self.shadow["below"][i]
        lo, hi = (self.b[a] if a >= 0 else 0.0), (self.t[c] if c >= 0 else self.page_bottom)
        up = down = NONE
        if len(self.h):
            x, y, x2 = self.h[:, 0], self.h[:, 1], self.h[:, 0] + self.h[:, 2]
            over = ((x < l) & (x2 > l)) | ((x < r) & (x2 > r))
            up = y[over & (y > t - REACH) & (y < t) & ((lo <= 0) | (y > lo))]
            down = y[over & (y > b) & (y < b + REACH) & (y < hi)]
        self.ruled["top"][i], self.ruled["bottom"][i] = len(up) > 0, len(down) > 0
        self.vis["top"][i] = float(up.max()) if len(up) else min(lo, t) + abs(t - lo) / 2 if lo > 0 else 0.0
        self.vis["bottom"][i] = float(down.min()) if len(down) else min(b, hi) + abs(hi - b) / 2

    def neighbours(self, i: int, direction: str) -> list[int]:
        mid, centre, lo, hi = self.mid, self.centre, self.vis["left"][i], self.vis["right"][i]
        if direction == "below":
            by = self.by("top")
            under = (by[k] for k in range(bisect_right(self.tops, self.t[i] + SEPARATION), bisect_left(self.tops, self.t[i] + REACH)))
            return self.apart((c for c in under if lo < centre[c] < hi), self.l, self.r, self.on_line)
        if direction == "above":
            over = self.ending(self.by("bottom"), self.bottoms, self.b[i])
            return self.apart((c for c in over if lo < centre[c] < hi), self.l, self.r, self.on_line)
        vt, vb = self.vis["top"][i], self.vis["bottom"][i]
        band = [c for c in self.span(vt - self.tallest - 1, vb) if vt < mid[c] < vb]
        if direction == "right":
            found = sorted((c for c in band if self.l[c] > self.r[i]), key=lambda c: (self.l[c], mid[c], self.ids[c]))
        else:
            found = sorted((c for c in band if self.r[c] < self.l[i]), key=lambda c: (-self.r[c], mid[c], self.ids[c]))
        return self.apart(found, self.t, self.b, self.on_column)

    def apart(self, found: Iterable[int], lo: list[float], hi: list[float], same: Callable[[int, int], bool]) -> list[int]:
        """Candidates of the first two lines that do not overlap one taken before."""
        out: list[int] = []
        last, line = -1, 0
        for c in found:
            if last >= 0 and not same(last, c):
                line += 1
                if line == 2:
                    break
            for o in out:
                if not (hi[c] < lo[o] or lo[c] > hi[o]):
                    break
            else:
                out.append(c)
            last = c
        return out

    # --- paragraphs

    def find_groups(self) -> None:
        """Paragraphs: each element takes those in its shadow while height, gap and neighbours allow."""
        for i in self.reading:
            if self.group[i] >= 0:
                continue
            run, gap, last = [i], -1.0, i
            while True:
                c = self.shadow["below"][last]
                if c < 0 or self.kind[c] != "text" or self.kind[i] != "text" or self.group[c] >= 0 or c in run:
                    break
                if self.ruled["top"][c] and not (self.options.detect_underline and self.vis["top"][c] - self.b[last] <= BORDER):
                    break
                if not self.share(last, c) or not self.h_[last] or abs(self.h_[c] / self.h_[last] - 1) > HEIGHT_VARIES:
                    break
                new = self.t[c] - self.b[last]
                if len(run) == 1:
                    if new > self.options.positional_grouping_max_distance_factor * self.h_[last]:
                        break
                elif (gap == 0 and new != 0) or (gap != 0 and abs(new / gap - 1) > GAP_VARIES):
                    if new < gap:
                        run.pop()
                    break
                hits = lambda a, b: any(s >= 0 and self.share(s, b) > 0 for s in (self.shadow["left"][a], self.shadow["right"][a]))
                if hits(last, c) or hits(c, last):
                    break
                run.append(c)
                gap, last = new, c
            for c in run:
                self.group[c] = len(self.groups)
            self.groups.append(run)

    # --- tables

    def aligned(self, i: int, other: int) -> bool:
        """Whether an element and its neighbour beside it stand on a row."""
        if other < 0:
            return True
        if self.kind[other] != "text" or self.table[other] >= 0:
            return False
        far = max(abs(self.l[i] - self.l[other]), 1e-9)
        if abs(self.t[i] - self.t[other]) / far > SLOPE and abs(self.b[i] - self.b[other]) / far > SLOPE:
            a, b = self.groups[self.group[i]], self.groups[self.group[other]]
            mid = lambda g: (self.t[g[0]] + self.b[g[-1]]) / 2
            return abs(mid(a) - mid(b)) / max(abs(min(self.l[c] for c in a) - min(self.l[c] for c in b)), 1e-9) <= SLOPE
        return self.h_[i] > 0 and abs(self.h_[other] / self.h_[i] - 1) <= ROW_VARIES

    def bounds(self, i: int) -> tuple[float, float]:
        """How far a column may reach at an element."""
        l, r = self.shadow["left"][i], self.shadow["right"][i]
        open_left, open_right = l < 0 and not self.ruled["left"][i], r < 0 and not self.ruled["right"][i]
        wide = [c for c in self.neighbours(i, "below") if self.w[c] > SMALL] if open_left or open_right else []
        lo = self.vis["left"][i] if self.ruled["left"][i] else self.r[l] if l >= 0 else max([self.r[c] for c in wide if self.r[c] < self.l[i]], default=self.vis["left"][i])
        hi = self.vis["right"][i] if self.ruled["right"][i] else self.l[r] if r >= 0 else min([self.l[c] for c in wide if self.l[c] > self.r[i]], default=self.vis["right"][i])
        return lo, hi

    def wide_overlap(self, lo: float, hi: float, c: int) -> bool:
        return c >= 0 and self.w[c] > SMALL and min(hi, self.r[c]) > max(lo, self.l[c]) + SMALL

    def column(self, start: int, strict: bool) -> dict:
        """The elements under one that form a column with it, where the column ends, and whether it has company on the left."""
        (lo, hi), left, right, run, i = self.bounds(start), self.l[start], self.r[start], [start], start
        ok_left = ok_right = True
        left_seen = 0
        stop = -1
        while True:
            top = self.t[i]
            c = self.below(top, lo, hi, left, right)
            while c >= 0 and self.kind[c] == "text" and not max(min(self.r[c], right) - max(self.l[c], left), 0.0):
                if self.w[c] > SMALL:
                    lo, hi = (self.r[c], hi) if self.r[c] < left else (lo, self.l[c])
                c = self.below(self.t[c] + SEPARATION, lo, hi, left, right)
            stop = c
            if c < 0 or self.table[c] >= 0 or self.kind[c] != "text":
                break
            cl, cr = self.shadow["left"][c], self.shadow["right"][c]
            if strict:
                ok_left, ok_right = ok_left and self.aligned(c, cl), ok_right and self.aligned(c, cr)
                if not ok_left and not ok_right:
                    break
            if self.l[c] >= lo - FIT and self.r[c] <= hi + FIT and not self.wide_overlap(left, right, cl) and not self.wide_overlap(left, right, cr):
                l2, h2 = self.bounds(c)
                lo = max(lo, l2) if cl < 0 or self.w[cl] > SMALL else lo
                hi = min(hi, h2) if cr < 0 or self.w[cr] > SMALL else hi
                left_seen += cl >= 0 and ok_left
                left, right = min(left, self.l[c]), max(right, self.r[c])
            elif any(re.fullmatch(p, self.text[c]) for p in self.options.tabular_noise_patterns) or self.noise & set(self.groups[self.group[c]]):
                self.noise.add(c)
            else:
                break
            run.append(c)
            i = c
        if stop >= 0 and self.group[stop] >= 0 and run[-1] in self.groups[self.group[stop]]:
            stop = self.groups[self.group[stop]][0]
        return {"run": run, "both": left_seen > 0, "boundary": self.page_bottom if stop < 0 else self.t[stop], "bottom": self.b[run[-1]]}

    def meets_line(self, i: int, run: list[int]) -> bool:
        """Whether one of a run, texts each lower than the one before, shares height with an element."""
        k = bisect_right(run, self.t[i] - self.tallest - 1, key=self.t.__getitem__)
        while k < len(run) and self.t[run[k]] < self.b[i]:
            if self.on_line(i, run[k]):
                return True
            k += 1
        return False

    def extent(self, first: dict) -> tuple[float, float, float, float]:
        """Top, right, bottom and left of the table that a first column begins."""
        run = first["run"]
        left, right = min(self.l[c] for c in run) - SEPARATION, max(self.r[c] for c in run)
        ends, deepest = [first["boundary"]], first["bottom"]
        for direction in ("right", "left") if first["both"] else ("right",):
            union, tried = list(run), set()
            limit = np.inf if direction == "right" else 0.0
            while True:
                start = -1
                for i in union:
                    o = self.shadow[direction][i]
                    if not self.aligned(i, o):
                        limit = min(limit, self.l[i]) if direction == "right" else max(limit, self.r[i])
                    elif start < 0 <= o and o not in tried and (self.r[i] < limit if direction == "right" else self.l[i] > limit):
                        start = o
                if start < 0:
                    break
                tried.add(start)
                c = self.column(start, False)
                if self.l[start] > right if direction == "right" else self.r[start] < left:
                    ends.append(c["boundary"])
                    deepest = max(deepest, c["bottom"])
                # rows of the union are those of the new column where both have one
                kept = [i for i in union if not self.meets_line(i, c["run"])]
                union = sorted([*kept, *c["run"]], key=lambda i: (self.t[i], self.idx[i]))
                union = [i for i in union if self.t[i] <= c["boundary"]]
                if not union:
                    break
                right, left = max(right, max(self.r[i] for i in union)), min(left, min(self.l[i] for i in union))
        bad, bottom = 0.5 * len(ends), self.page_bottom
        for k, e in enumerate(sorted(ends), 1):
            if k >= bad or e > deepest:
                bottom = e
                break
        return self.t[run[0]] - SEPARATION, right, bottom, left

    def find_tables(self) -> list[list[int]]:
        """Tables in element order; gives the elements of each."""
        found: list[list[int]] = []
        for i in self.reading:
            if self.kind[i] != "text" or self.table[i] >= 0:
                continue
            r = self.shadow["right"][i]
            if r < 0 or not self.aligned(i, r):
                continue
            first = self.column(i, True)
            if len(first["run"]) < 2:
                continue
            top, right, bottom, left = self.extent(first)
            if bottom < top or right < left:
                continue
            if (made := self.fill(top, right, bottom, left)) is not None:
                rows, cols = made
                for e, k in rows.items():
                    self.table[e], self.row[e], self.col[e] = len(found), k, cols.get(e, 0)
                found.append(list(rows))
        return found

    def fill(self, top: float, right: float, bottom: float, left: float) -> tuple[dict[int, int], dict[int, int]] | None:
        """Row and column of each element of a table within bounds, or None where they make no table."""
        inside = self.span(top - self.tallest - 1, bottom)
        inside = [c for c in inside if top < self.b[c] < bottom and self.r[c] > left and self.l[c] < right and self.kind[c] == "text" and self.table[c] < 0]
        rows: list[list[int]] = []
        widest = 0
        for c in inside:
            if rows and self.on_line(rows[-1][-1], c):
                rows[-1].append(c)
                continue
            if rows:
                last = rows[-1][-1]
                gap = max(int(self.t[c] - self.t[last]), 1)
                across = self.page[c] != self.page[last]
                most = ROW_GAP + (40 if across and self.options.enable_grid_based_table_detection else 0)
                far = gap > most if across else gap > ROW_GAP or (widest > 0 and len(rows) > 1 and gap / widest > ROW_GAP_GROWS)
                if far or (not across and self.font[last] > 0 and self.font[c] / self.font[last] > FONT_GROWS):
                    break
                if len(rows) > 1 and self.jumps(rows[-2], rows[-1]):
                    rows.pop()
                    break
                widest = max(widest, 0 if across else gap)
            rows.append([c])
        else:
            if len(rows) > 2 and self.jumps(rows[-2], rows[-1]):
                rows.pop()
        if len(rows) < 2 or sum(len(r) > 1 for r in rows) < 2:
            return None
        # the first row brings what stands above it in its paragraphs
        heads = [self.groups[self.group[c]] for c in rows[0]]
        heads = [[e for e in g[: g.index(c) + 1] if self.table[e] < 0] for g, c in zip(heads, rows[0], strict=True)]
        deep = max(len(h) for h in heads)
        at = {e: deep - len(h) + k for h in heads for k, e in enumerate(h)} | {c: deep + k for k, r in enumerate(rows[1:]) for c in r}
        cols = self.columns([c for r in rows for c in r], {c: at[c] for r in rows for c in r})
        if cols is None:
            return None
        for h, c in zip(heads, rows[0], strict=True):
            cols |= dict.fromkeys(h, cols[c])
        return at, cols

    def jumps(self, above: list[int], row: list[int]) -> bool:
        measure = self.options.semantic_jump_calculator or digit_jump
        return self.bold[row[0]] and measure([self.text[c] for c in above], [self.text[c] for c in row]) > JUMP

    def columns(self, elements: list[int], row_of: dict[int, int]) -> dict[int, int] | None:
        """Column of each element, from left to right: a new one begins where most of those before end left of it."""
        order = sorted(elements, key=lambda c: (self.l[c], self.t[c], self.idx[c]))
        rights: list[float] = []
        seen: set[int] = set()
        now, out = 0, {}
        for k, c in enumerate(order):
            if c not in self.noise:
                room = self.w[c] - min(self.l[order[k + 1]] - self.l[c], self.w[c]) if k + 1 < len(order) else self.w[c] if not rights or self.l[c] > max(rights) else 0.0
                ended = sum(r < self.l[c] for r in rights)
                if (ended == len(rights) or (room > 0 and rights and ended / len(rights) > 0.5)) and (len(rights) > 1 or row_of[c] in seen):
                    now, rights, seen = now + 1, [], set()
                if self.text[c] not in ("$", "€"):
                    rights.append(self.r[c])
                    seen.add(row_of[c])
            out[c] = now
        return out if now else None

    def column_of(self, name: str) -> list:
        """A column of the context, in element order of the page."""
        kind, _, side = name.partition("_")
        if kind == "shadow":
            return [None if x < 0 else self.idx[x] for x in self.shadow[side]]
        if kind in ("vis", "border"):
            return (self.vis if kind == "vis" else self.ruled)[side]
        if kind == "align":
            return self.align_left if side == "left" else self.align_right
        if side == "ids":
            return [[self.idx[c] for c in x] for x in self.near[kind]]
        if name == "elem_idx":
            return self.idx
        return [None if x < 0 else x for x in {"vg_id": self.group, "table_id": self.table, "t_row": self.row, "t_col": self.col}[name]]

    def analyse(self) -> Sheet:
        self.find_alignment()
        self.find_context()
        self.find_groups()
        if not self.options.disable_table_detection:
            self.find_tables()
        return self


def _in_disorder(tops: list, ids: list) -> bool:
    """Whether elements are not in order of top and place."""
    last, place = float("-inf"), -1
    for t, k in zip(tops, ids, strict=True):
        if not (t > last or (t == last and k >= place)):
            return True
        last, place = t, k
    return False


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole documents from batches in which a document's rows follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("doc_id").to_pylist()
        start = len(ids) - 1
        while start and ids[start - 1] == ids[-1]:
            start -= 1
        if held and held[-1].column("doc_id")[-1].as_py() == ids[-1] and not start:
            held.append(batch)
            continue
        if held or start:
            yield pa.Table.from_batches([*held, *([batch.slice(0, start)] if start else [])])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def document_layout(elements: DataFrame, options: Options | None = None, page_width: float = 612.0, columns: list[str] | None = None) -> DataFrame:
    """Spatial context, paragraph and table place of every element of each document (``columns`` of ``CONTEXT``, None for all).

    Columns that are not asked for, and that those asked for do not need, are not found out.
    """
    schema = StructType([f for f in StructType.fromDDL(CONTEXT) if columns is None or f.name in (*columns, "doc_id", "elem_idx")])
    names, want = schema.names[2:], None if columns is None else set(columns)
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _documents(batches):
            ids, rows = table.column("doc_id").to_pylist(), {c: table.column(c).to_pylist() for c in _NEED[1:]}
            docs, places, out, start = [], [], [[] for _ in names], 0
            for end in range(1, len(ids) + 1):
                if end < len(ids) and ids[end] == ids[start]:
                    continue
                sheet = Sheet({c: x[start:end] for c, x in rows.items()}, page_width, None, options, want).analyse()
                docs += [ids[start]] * sheet.n
                places += sheet.idx
                for put, name in zip(out, names, strict=True):
                    put += sheet.column_of(name)
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([docs, places, *out], types, strict=True)], names=schema.names)

    have = elements.columns
    kinds = {"doc_id": "bigint", "elem_idx": "int", "text": "string", "stretch": "double", "styles": "array<string>", "font_size": "double", "page_no": "int", "kind": "string"}
    source = elements.select(*[F.col(c) if c in have else F.lit("text" if c == "kind" else None if c != "page_no" else 0).cast(kinds.get(c, "double")).alias(c) for c in _NEED])
    # the window brings a document's elements together, in order and without a shuffle where the table has been shuffled on documents
    together = source.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("top", F.lit(0.0)), "elem_idx")))
    return together.mapInArrow(run, schema)


def cells_of(elements: DataFrame, context: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, col, text, elem_ids) of the tables found, empty cells included."""
    placed = elements.select("doc_id", "elem_idx", "text").join(context.where("table_id IS NOT NULL").select("doc_id", "elem_idx", "table_id", F.col("t_row").alias("row"), F.col("t_col").alias("col")).hint("merge"), ["doc_id", "elem_idx"])  # never broadcast: far larger than the planner thinks
    each = F.array_sort(F.collect_list(F.struct("elem_idx", "text")))
    filled = placed.groupBy("doc_id", "table_id", "row", "col").agg(F.array_join(F.transform(each, lambda x: x["text"]), "\t").alias("text"), F.transform(each, lambda x: x["elem_idx"]).alias("elem_ids"))
    size = filled.groupBy("doc_id", "table_id").agg(F.max("row").alias("r"), F.max("col").alias("c"))
    grid = size.withColumn("row", F.explode(F.sequence(F.lit(0), "r"))).withColumn("col", F.explode(F.sequence(F.lit(0), "c"))).drop("r", "c")
    return grid.join(filled.hint("merge"), ["doc_id", "table_id", "row", "col"], "left").select("doc_id", "table_id", "row", "col", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("elem_ids", F.array().cast("array<int>")).alias("elem_ids"))
