"""Points against polygons by quadtree covers and widening rings.

A polygon is any number of closed rings under the even-odd rule, so
holes and multipolygons need nothing of their own.

*Cover*: each polygon becomes cells of a quadtree whose sides are powers
of two, from its own size downwards, so a large and a tiny polygon both
have few.  A cell that no edge touches is interior (or left out); a
border cell carries the edges that touch it, a reference point inside it
and on which side of the polygon that point lies.  A point joins on its
cell at every side length in use: an interior cell is an answer, in a
border cell the edges between the reference point and the point are
counted.  No ring travels whole to the join.

*Nearest*: edges are laid into grid cells one cell further than they
reach, so a point sees every edge within one cell side.  If the best of
them is no further than that, nothing else can be nearer and the point
is settled; the others go on with cells four times as long.  The first
side is the least at which the edges fill at most ``FILL`` cells each,
counted for all lengths in one pass.  A cell's edges come in rows of
about ``ROW`` and a point takes the best of a row where it meets it, so
what is aggregated per point grows with the points, not with the edges
they see.

A hot cell is split by AQE's skew join (all tests are row-local, and the
best per point is a partial aggregate).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toposim.session import materialize, ship

#: Edges of a border cell beyond which it is split, and how often at most.
EDGES, DEPTH = 8, 10
#: Grid cells an edge fills on average in the first round of ``nearest``.
FILL = 4
#: Edges of a grid cell that a row of the join holds on average at most.
ROW = 256
_EDGE = "struct<ax:double,ay:double,bx:double,by:double>"
_COVER = f"e int, cx long, cy long, inside boolean, rx double, ry double, edges array<{_EDGE}>"


def rings_of(polys: DataFrame) -> DataFrame:
    """``polys`` with ``rings``: the column itself, or the one ``ring``."""
    return polys if "rings" in polys.columns else polys.withColumn("rings", F.array("ring"))


def edges_of(polys: DataFrame) -> DataFrame:
    """(id, ax, ay, bx, by): the edges of all rings."""
    r = rings_of(polys).select("id", F.explode("rings").alias("r"))
    pair = F.zip_with(F.slice("r", F.lit(1), F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))),
                      lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    return r.select("id", F.explode(pair).alias("s")).select("id", "s.*")


def _side(px, py, qx, qy, rx, ry):
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def _crossed(edges: np.ndarray, px, py, qx, qy) -> int:
    """Edges between two points: those whose ends lie on two sides of the
    line through the points, and whose own line parts the points."""
    ax, ay, bx, by = edges.T
    over = (_side(px, py, qx, qy, ax, ay) > 0) != (_side(px, py, qx, qy, bx, by) > 0)
    apart = (_side(ax, ay, bx, by, px, py) > 0) != (_side(ax, ay, bx, by, qx, qy) > 0)
    return int((over & apart).sum())


def _touching(edges: np.ndarray, x: float, y: float, s: float) -> np.ndarray:
    """Edges that may touch a cell (a little too many, never too few)."""
    ax, ay, bx, by = edges.T
    d = s * 1e-9 + (abs(x) + abs(y)) * 1e-12
    x0, y0, x1, y1 = x - d, y - d, x + s + d, y + s + d
    box = (np.minimum(ax, bx) <= x1) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y1) & (np.maximum(ay, by) >= y0)
    corner = np.stack([_side(ax, ay, bx, by, px, py) for px in (x0, x1) for py in (y0, y1)])
    far = np.abs(bx - ax) + np.abs(by - ay)
    return edges[box & (corner.min(0) <= far * d) & (corner.max(0) >= -far * d)]


def _reference(edges: np.ndarray, x: float, y: float, s: float) -> tuple[float, float]:
    """A point of the cell away from all its edges' lines."""
    best, most = (x + s / 2, y + s / 2), -1.0
    if not len(edges):
        return best
    ax, ay, bx, by = edges.T
    length = np.hypot(bx - ax, by - ay)
    for u, v in ((0.5, 0.5), (0.47, 0.53), (0.391, 0.457), (0.613, 0.571), (0.717, 0.283), (0.271, 0.733)):
        p = (x + u * s, y + v * s)
        clear = float((np.abs(_side(ax, ay, bx, by, *p)) / length).min())
        if clear > most:
            best, most = p, clear
        if clear > s / 100:
            break
    return best


def cells_of(edges: np.ndarray, most: int = EDGES, depth: int = DEPTH) -> Iterator[tuple]:
    """(e, cx, cy, inside, rx, ry, edges or None): a polygon's cover."""
    edges = edges[(edges[:, 0] != edges[:, 2]) | (edges[:, 1] != edges[:, 3])]
    if not len(edges):
        return
    xs, ys = edges[:, ::2], edges[:, 1::2]
    root = math.ceil(math.log2(max(xs.max() - xs.min(), ys.max() - ys.min())))
    s = 2.0 ** root
    todo = []
    for cx in range(math.floor(xs.min() / s), math.floor(xs.max() / s) + 1):
        for cy in range(math.floor(ys.min() / s), math.floor(ys.max() / s) + 1):
            mine = _touching(edges, cx * s, cy * s, s)
            rx, ry = _reference(edges, cx * s, cy * s, s)
            ax, ay, bx, by = edges.T
            up = (ay > ry) != (by > ry)
            with np.errstate(divide="ignore", invalid="ignore"):
                inside = bool((up & (rx < ax + (ry - ay) * (bx - ax) / (by - ay))).sum() % 2)
            todo.append((root, cx, cy, mine, rx, ry, inside))
    while todo:
        e, cx, cy, mine, rx, ry, inside = todo.pop()
        if not len(mine):
            if inside:
                yield e, cx, cy, True, rx, ry, None
        elif len(mine) <= most or e <= root - depth:
            yield e, cx, cy, inside, rx, ry, mine
        else:
            s = 2.0 ** (e - 1)
            for x, y in ((2 * cx, 2 * cy), (2 * cx + 1, 2 * cy), (2 * cx, 2 * cy + 1), (2 * cx + 1, 2 * cy + 1)):
                part = _touching(mine, x * s, y * s, s)
                px, py = _reference(part, x * s, y * s, s)
                todo.append((e - 1, x, y, part, px, py, inside ^ bool(_crossed(mine, rx, ry, px, py) % 2)))


def cover(polys: DataFrame) -> DataFrame:
    """(id, e, cx, cy, inside, rx, ry, edges) for every polygon; ``edges``
    is null in an interior cell.  Cells have sides of 2 to the power e."""
    ship(polys.sparkSession)
    p = edges_of(polys).groupBy("id").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"))
    kind = p.schema["id"].dataType.simpleString()
    names = ("ax", "ay", "bx", "by")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pid, edges in zip(b.column("id"), b.column("edges").to_pylist()):
                rows = list(cells_of(np.array([[s[n] for n in names] for s in edges], float)))
                if rows:
                    e, cx, cy, inside, rx, ry, es = zip(*rows)
                    held = [None if x is None else [dict(zip(names, r)) for r in x.tolist()] for x in es]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([pid.as_py()] * len(rows), b.schema.field("id").type), pa.array(e, pa.int32()), pa.array(cx, pa.int64()),
                         pa.array(cy, pa.int64()), pa.array(inside, pa.bool_()), pa.array(rx, pa.float64()), pa.array(ry, pa.float64()),
                         pa.array(held, pa.list_(pa.struct([(n, pa.float64()) for n in names])))],
                        names=["id", "e", "cx", "cy", "inside", "rx", "ry", "edges"])

    return p.mapInArrow(run, f"id {kind}, {_COVER}")


def _parted(x: Column, y: Column) -> Column:
    """Whether an odd number of the cell's edges lies between its reference point and (x, y)."""
    rx, ry = F.col("rx"), F.col("ry")

    def hit(s: Column) -> Column:
        over = (_side(rx, ry, x, y, s["ax"], s["ay"]) > 0) != (_side(rx, ry, x, y, s["bx"], s["by"]) > 0)
        apart = (_side(s["ax"], s["ay"], s["bx"], s["by"], rx, ry) > 0) != (_side(s["ax"], s["ay"], s["bx"], s["by"], x, y) > 0)
        return over & apart

    return F.size(F.filter("edges", hit)) % 2 == 1


def _on_edge(x: Column, y: Column) -> Column:
    def on(s: Column) -> Column:
        return ((_side(s["ax"], s["ay"], s["bx"], s["by"], x, y) == 0)
                & (x >= F.least(s["ax"], s["bx"])) & (x <= F.greatest(s["ax"], s["bx"]))
                & (y >= F.least(s["ay"], s["by"])) & (y <= F.greatest(s["ay"], s["by"])))
    return F.exists("edges", on)


def located(points: DataFrame, polys: DataFrame) -> DataFrame:
    """(poi_id, id, within): every polygon a point lies in (``within``) or
    on the border of."""
    cells = materialize(cover(polys), "cover")
    sides = sorted(r.e for r in cells.select("e").distinct().collect())  # powers of two in use
    if not sides:
        return points.join(polys.select("id"), F.lit(False)).select("poi_id", "id", F.lit(True).alias("within"))
    at = points.select("poi_id", "x", "y", F.explode(F.array(*[F.lit(e) for e in sides])).alias("e"))
    at = at.select("*", F.floor(F.col("x") / F.pow(F.lit(2.0), F.col("e"))).alias("cx"), F.floor(F.col("y") / F.pow(F.lit(2.0), F.col("e"))).alias("cy"))
    x, y = F.col("x"), F.col("y")
    d = at.join(cells, ["e", "cx", "cy"])
    d = d.select("poi_id", "id", F.when(F.col("edges").isNull(), F.lit(True)).otherwise(F.col("inside") != _parted(x, y)).alias("inside"),
                 F.when(F.col("edges").isNull(), F.lit(False)).otherwise(_on_edge(x, y)).alias("border"))
    return d.where("inside OR border").select("poi_id", "id", (~F.col("border")).alias("within"))


def _distance(e: Column | None = None) -> Column:
    """From (x, y) to the edge ``e``, or to that of the same row."""
    ax, ay, bx, by = (F.col(k) if e is None else e[k] for k in ("ax", "ay", "bx", "by"))
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - ax) * dx + (F.col("y") - ay) * dy) / square)))
    return F.sqrt((F.col("x") - (ax + t * dx)) ** 2 + (F.col("y") - (ay + t * dy)) ** 2)


def _cells(edges: DataFrame, side: float) -> DataFrame:
    """Edges in every cell within one cell of their boxes."""
    lo = lambda a, b: F.floor((F.least(a, b) - side) / side)
    hi = lambda a, b: F.floor((F.greatest(a, b) + side) / side)
    d = edges.select("*", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx"))).alias("cx"))
    return d.select("*", F.explode(F.sequence(lo("ay", "by"), hi("ay", "by"))).alias("cy"))


def _cell_rows(edges: DataFrame, side: float, row: int = ROW) -> DataFrame:
    """(cx, cy, edges): the edges of every cell, dealt by hash to as many
    rows as they need."""
    cells = _cells(edges, side)
    rows = cells.groupBy("cx", "cy").agg(F.ceil(F.count("*") / row).alias("rows"))
    mine = F.pmod(F.xxhash64("id", "ax", "ay", "bx", "by"), F.col("rows"))
    held = cells.join(rows, ["cx", "cy"]).groupBy("cx", "cy", mine.alias("row"))
    return held.agg(F.collect_list(F.struct("id", "ax", "ay", "bx", "by")).alias("edges")).drop("row")


def _first_side(edges: DataFrame) -> tuple[float, float]:
    """(side of the first round, length that spans all edges)."""
    box = edges.agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"),
                    F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1"), F.count("*").alias("n")).first()
    if not box.n:
        return 1.0, 0.0
    span = max(box.x1 - box.x0, box.y1 - box.y0, 1e-9)
    tried = [2.0 ** (math.ceil(math.log2(span)) - k) for k in range(24)]
    filled = [F.sum((F.floor(F.abs(F.col("bx") - F.col("ax")) / s) + 1) * (F.floor(F.abs(F.col("by") - F.col("ay")) / s) + 1)) for s in tried]
    counts = edges.agg(*[f.alias(f"f{k}") for k, f in enumerate(filled)]).first()
    return min(s for s, n in zip(tried, counts) if n <= FILL * box.n or s == tried[0]), span


def within_distance(points: DataFrame, polys: DataFrame, reach: float) -> DataFrame:
    """(poi_id, id, distance): border distances under ``reach``, one row a pair."""
    cells = _cells(edges_of(polys), float(reach))
    at = points.select("poi_id", "x", "y", F.floor(F.col("x") / reach).alias("cx"), F.floor(F.col("y") / reach).alias("cy"))
    d = at.join(cells, ["cx", "cy"]).select("poi_id", "id", _distance().alias("distance")).where(F.round("distance", 9) < reach)
    return d.groupBy("poi_id", "id").agg(F.min("distance").alias("distance"))


def nearest(points: DataFrame, polys: DataFrame, dist_max: float | None = None) -> DataFrame:
    """(poi_id, id, distance): the nearest polygon of every point, 0 inside
    or on the border; ties (to 9 decimals) go to the lowest id.  With
    ``dist_max`` only those nearer than it."""
    inside = materialize(located(points, polys).groupBy("poi_id").agg(F.min("id").alias("id")), "located")
    done = inside.select("poi_id", "id", F.lit(0.0).alias("distance"))
    left = materialize(points.select("poi_id", "x", "y").join(inside, "poi_id", "left_anti"), "unsettled")
    edges = materialize(edges_of(polys).distinct(), "edges")
    side, span = _first_side(edges)
    if not span:
        return done
    ends = left.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0.0
    widest = edges.agg(F.max(F.greatest(F.abs("ax"), F.abs("ay"), F.abs("bx"), F.abs("by")))).first()[0]
    while left.limit(1).count():
        last = side >= 2 * (ends + widest) or dist_max is not None and side >= dist_max
        at = left.select("*", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
        one = F.array_min(F.transform("edges", lambda e: F.struct(F.round(_distance(e), 9).alias("r"), e["id"].alias("id"), _distance(e).alias("d"))))
        cells = materialize(_cell_rows(edges, side), "cells")  # of known size: few are broadcast
        best = at.join(cells, ["cx", "cy"]).select("poi_id", one.alias("b")).groupBy("poi_id").agg(F.min("b").alias("b"))
        best = best.where(F.lit(last) | (F.col("b.r") < side))
        best = materialize(best.select("poi_id", "b.id", F.col("b.d").alias("distance"), "b.r"), "settled")
        done = done.unionByName((best if dist_max is None else best.where(F.col("r") < dist_max)).drop("r"))
        if last:
            break
        left = materialize(left.join(best, "poi_id", "left_anti"), "unsettled")
        side *= 4
    return done
