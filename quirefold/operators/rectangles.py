"""Rectangles that ruling lines close, and the grids that adjacent ones form; one Arrow group a page.

Horizontal lines split a page in bands, vertical ones that cross a band split it in cells.  A cell is closed where lines
bound it on all four sides within ``TOLERANCE``; cells that share a side make one polygon, whose rows and columns are
counted.  Polygons of more than one cell are bounding boxes for what stands in them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..options import Options

TOLERANCE = 2.0
SCHEMA = "doc_id bigint, page_no int, rect_id int, polygon_id int, top double, left double, width double, height double, n_rows int, n_cols int"


def merge_lines(lines: np.ndarray, epsilon: float = 1.0) -> np.ndarray:
    """Lines (position, begin, end) of one direction, joined where they lie within epsilon and touch; positions averaged."""
    out: list[list[float]] = []
    for p, a, b in sorted(map(tuple, lines)):
        near = next((o for o in reversed(out) if p - o[0] <= epsilon and a <= o[2] + epsilon and b >= o[1] - epsilon), None)
        if near is None:
            out.append([p, a, b, 1])
        else:
            near[:] = (near[0] * near[3] + p) / (near[3] + 1), min(near[1], a), max(near[2], b), near[3] + 1
    return np.array([o[:3] for o in out]).reshape(-1, 3)


def closed(h: np.ndarray, v: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Smallest closed rectangles (top, left, bottom, right) from lines (position, begin, end)."""
    out = []
    h, v = h[np.lexsort((h[:, 1], h[:, 0]))], v[np.lexsort((v[:, 1], v[:, 0]))]
    for y, a, b in h:
        xs = v[(v[:, 0] >= a - TOLERANCE) & (v[:, 0] <= b + TOLERANCE) & (v[:, 1] <= y + TOLERANCE) & (v[:, 2] > y + TOLERANCE)]
        for k in range(len(xs) - 1):
            (l, _, e1), (r, _, e2) = xs[k], xs[k + 1]
            if r - l <= TOLERANCE:
                continue
            below = h[(h[:, 0] > y + TOLERANCE) & (h[:, 0] <= min(e1, e2) + TOLERANCE) & (h[:, 1] <= l + TOLERANCE) & (h[:, 2] >= r - TOLERANCE)]
            if len(below):
                out.append((y, l, float(below[0, 0]), r))
    return list(dict.fromkeys(out))


def polygons(rects: list[tuple[float, float, float, float]]) -> list[int]:
    """The polygon of each rectangle: connected over shared sides."""
    label = list(range(len(rects)))

    def top(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    near = lambda a, b: abs(a - b) <= TOLERANCE
    # only those that begin beside or above a rectangle's edges can touch it
    order = sorted(range(len(rects)), key=lambda k: rects[k][0])
    tops = [rects[k][0] for k in order]
    tallest = max((b - t for t, _, b, _ in rects), default=0.0)
    for i, (t, l, b, r) in enumerate(rects):
        for j in sorted(order[bisect_left(tops, t - tallest - 2 * TOLERANCE) : bisect_right(tops, b + 2 * TOLERANCE)]):
            if j >= i:
                break
            t2, l2, b2, r2 = rects[j]
            side = (near(r, l2) or near(l, r2)) and min(b, b2) - max(t, t2) > TOLERANCE
            stacked = (near(b, t2) or near(t, b2)) and min(r, r2) - max(l, l2) > TOLERANCE
            if side or stacked:
                label[top(i)] = top(j)
    return [top(i) for i in range(len(rects))]


def rectangles(rules: DataFrame, epsilon: float | None = None, options: Options | None = None) -> DataFrame:
    """Closed rectangles of every page and the polygons that they form, from lines (doc_id, page_no, kind, top, left, stretch)."""
    epsilon = (options or Options()).line_merge_epsilon if epsilon is None else epsilon

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        doc, page = (k.as_py() for k in key)
        # an absent number is no place, and meets nothing
        kinds, (top, left, stretch) = rows.column("kind").to_numpy(), (rows.column(c).to_numpy().astype(float) for c in ("top", "left", "stretch"))
        v, h = kinds == "vline", kinds == "hline"
        vs = merge_lines(np.stack([left[v], top[v], top[v] + stretch[v]], axis=1), epsilon) if v.any() else np.zeros((0, 3))
        hs = merge_lines(np.stack([top[h], left[h], left[h] + stretch[h]], axis=1), epsilon) if h.any() else np.zeros((0, 3))
        rects = closed(hs, vs) if len(hs) and len(vs) else []
        label = polygons(rects)
        places: dict[int, tuple[set[int], set[int]]] = {}
        for (t, l, _, _), p in zip(rects, label, strict=True):
            rows_, cols_ = places.setdefault(p, (set(), set()))
            rows_.add(round(t / TOLERANCE))
            cols_.add(round(l / TOLERANCE))
        found = [(doc, page, i, p, t, l, r - l, b - t, len(places[p][0]), len(places[p][1])) for i, ((t, l, b, r), p) in enumerate(zip(rects, label, strict=True))]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * len(schema), schema.types, strict=True)], schema=schema)

    source = rules.where("kind IN ('vline', 'hline')").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), "kind", *[F.col(c).cast("double").alias(c) for c in ("top", "left", "stretch")])
    return source.groupBy("doc_id", "page_no").applyInArrow(run, SCHEMA)


def bounding_boxes(found: DataFrame) -> DataFrame:
    """(doc_id, page_no, box_id, top, left, width, height) of polygons with at least two rows and two columns."""
    g = found.where("n_rows > 1 AND n_cols > 1").groupBy("doc_id", "page_no", F.col("polygon_id").alias("box_id"))
    edge = g.agg(F.min("top").alias("top"), F.min("left").alias("left"), F.max(F.col("left") + F.col("width")).alias("r"), F.max(F.col("top") + F.col("height")).alias("b"))
    return edge.select("doc_id", "page_no", "box_id", "top", "left", (F.col("r") - F.col("left")).alias("width"), (F.col("b") - F.col("top")).alias("height"))
