"""Contours of SVG documents: paths, areas, simplification, bridges."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacut.operators import batches
from stratacut.operators.components import _saved

CELLS = 64
NUMBER = re.compile(r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?")
COMMAND = re.compile(r"([MLHVCSQTAZz])([^A-Za-z]*)")


def paths(svgs: DataFrame) -> DataFrame:
    """(doc_id, path_id, d): the path strings of (doc_id, svg)."""
    return svgs.select("doc_id", F.posexplode(F.regexp_extract_all("svg", F.lit('d="([^"]*)"'), F.lit(1))).alias("path_id", "d"))


def rings_of(d: str) -> list[list[tuple[float, float]]]:
    """Closed rings of a path's absolute commands: curves at eighths, S as a quadratic by its control point, T and A as straight lines."""
    rings: list[list[tuple[float, float]]] = []
    ring: list[tuple[float, float]] = []
    x = y = 0.0
    taken = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7}
    for command, text in COMMAND.findall(d):
        if command in "Zz":
            if len(ring) >= 3:
                rings.append(ring)
            ring = []
            continue
        values = [float(v) for v in NUMBER.findall(text)]
        n = taken[command]
        if command == "M":
            if len(ring) >= 3:
                rings.append(ring)
            ring = []
        for k in range(0, len(values) - n + 1, n):
            v = values[k : k + n]
            if command in "HV":
                x, y = (v[0], y) if command == "H" else (x, v[0])
                ring.append((x, y))
                continue
            if command in "CSQ":
                for t in (i / 8 for i in range(1, 9)):
                    u = 1 - t
                    if command == "C":
                        ring.append(tuple(u**3 * a + 3 * u * u * t * v[i] + 3 * u * t * t * v[2 + i] + t**3 * v[4 + i] for i, a in enumerate((x, y))))
                    else:
                        ring.append(tuple(u * u * a + 2 * u * t * v[i] + t * t * v[2 + i] for i, a in enumerate((x, y))))
            else:
                ring.append((v[-2], v[-1]))
            x, y = v[-2], v[-1]
    if len(ring) >= 3:
        rings.append(ring)
    return rings


def flatten(found: DataFrame) -> DataFrame:
    """(doc_id, contour_id, seq, x, y): vertices of the rings of (doc_id, path_id, d); contour_id is path_id * 2^32 + ring."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, (path << 32) + k, s, x, y) for doc, path, d in batch.itertuples(index=False) for k, ring in enumerate(rings_of(d or "")) for s, (x, y) in enumerate(ring)]
            yield pd.DataFrame(rows, columns=["doc_id", "contour_id", "seq", "x", "y"])

    return found.select("doc_id", "path_id", "d").mapInPandas(emit, "doc_id long, contour_id long, seq int, x double, y double")


def edges(vertices: DataFrame) -> DataFrame:
    """Vertices with the next one of their ring (nx, ny); the last has the first."""
    ring = Window.partitionBy("doc_id", "contour_id").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    return vertices.withColumn("nx", nxt("x")).withColumn("ny", nxt("y"))


def areas(vertices: DataFrame) -> DataFrame:
    """(doc_id, contour_id, n, area): absolute shoelace area."""
    return edges(vertices).groupBy("doc_id", "contour_id").agg(F.count("*").alias("n"), (F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2).alias("area"))


def roles(measured: DataFrame) -> DataFrame:
    """Areas with role: the largest contour of a document is the mainland, the others islands; null in documents of one contour."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("area"), "contour_id")
    several = F.count("*").over(Window.partitionBy("doc_id")) > 1
    return measured.withColumn("role", F.when(several, F.when(F.row_number().over(order) == 1, "mainland").otherwise("island")))


def kept_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points Douglas-Peucker keeps: those farther than ``tolerance`` from the chord of their part."""
    keep = np.zeros(len(x), bool)
    if len(x):
        keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = np.hypot(dx, dy)
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        d = np.abs(px * dy - py * dx) / length if length else np.hypot(px, py)
        k = int(d.argmax())
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


VERTICES = "doc_id long, contour_id long, seq int, x double, y double"


def simplify(vertices: DataFrame, tolerance: float = 1.5, most: int = 100_000) -> DataFrame:
    """Vertices that Douglas-Peucker keeps, numbered anew. Contours of up to ``most`` vertices stay whole in a task, larger ones take rounds over all parts."""

    def some(rings: pd.DataFrame) -> pd.DataFrame:
        x, y, first = rings["x"].to_numpy(), rings["y"].to_numpy(), batches.starts(rings, key)
        kept = [kept_points(x[a:b], y[a:b], tolerance) for a, b in zip(first, [*first[1:], len(x)], strict=True)]
        seq = np.concatenate([np.arange(k.sum(), dtype=np.int32) for k in kept])
        return rings[np.concatenate(kept)].assign(seq=seq)

    key = ["doc_id", "contour_id"]
    listed = vertices.select(*key, "seq", "x", "y")
    sizes = listed.groupBy(*key).agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") > most).select(*key)
    small = batches.by_groups(listed.join(large, key, "left_anti"), key, ["seq"], some, VERTICES)
    return small if large.isEmpty() else small.unionByName(_simplified_by_rounds(_saved(listed.join(large, key, "left_semi")), tolerance))


def _simplified_by_rounds(vertices: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker a round a level: every part's farthest point from its chord splits the part or ends it, so no contour is one group."""
    key = ["doc_id", "contour_id"]
    ends = vertices.groupBy(*key).agg(F.min(F.struct("seq", "x", "y")).alias("a"), F.max(F.struct("seq", "x", "y")).alias("b"))
    kept = [_saved(ends.select(*key, F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select(*key, "p.*"))]
    left = _saved(vertices.join(ends, key).where((F.col("seq") > F.col("a.seq")) & (F.col("seq") < F.col("b.seq"))))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    px, py = F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
    # a point's distance over or along its chord; compared with the tolerance as the helper does
    length = F.hypot(dx, dy)
    away = F.when(length > 0, F.abs(px * dy - py * dx) / F.nullif(length, F.lit(0.0))).otherwise(F.hypot(px, py))
    while not left.isEmpty():
        part = [*key, F.col("a.seq").alias("part")]
        far = left.groupBy(*part).agg(F.max(F.struct(away.alias("d"), (-F.col("seq")).alias("back"), "x", "y")).alias("f")).where(F.col("f.d") > tolerance)
        split = _saved(far.select(*key, "part", F.struct((-F.col("f.back")).alias("seq"), F.col("f.x").alias("x"), F.col("f.y").alias("y")).alias("p")))
        kept.append(split.select(*key, "p.*"))
        halves = left.withColumn("part", F.col("a.seq")).join(split, [*key, "part"]).where(F.col("seq") != F.col("p.seq"))
        before = F.col("seq") < F.col("p.seq")
        left = _saved(halves.select(*key, "seq", "x", "y", F.when(before, F.col("a")).otherwise(F.col("p")).alias("a"), F.when(before, F.col("p")).otherwise(F.col("b")).alias("b")))
    stay = reduce(DataFrame.unionByName, kept)
    return stay.withColumn("seq", (F.row_number().over(Window.partitionBy(*key).orderBy("seq")) - 1).cast("int"))


def foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct<x,y,d2>: the nearest point of a segment and its squared distance."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(length, F.lit(0.0)))))
    fx, fy = ax + t * dx, ay + t * dy
    return F.struct(fx.alias("x"), fy.alias("y"), ((px - fx) * (px - fx) + (py - fy) * (py - fy)).alias("d2"))


def cross(a: tuple[Column, ...], b: tuple[Column, ...], margin: float) -> Column:
    """Whether two segments (x1, y1, x2, y2) meet inside, at least ``margin`` of their lengths from the ends; parallel ones don't."""
    ux, uy, vx, vy = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    det = ux * vy - uy * vx
    wx, wy = b[0] - a[0], b[1] - a[1]
    safe = F.when(F.abs(det) >= 1e-10, det)
    t, u = (wx * vy - wy * vx) / safe, (wx * uy - wy * ux) / safe
    inside = lambda v: (v > margin) & (v < 1 - margin)
    return F.coalesce(inside(t) & inside(u), F.lit(False))


def _ends(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every (n/200-th) vertex of the islands, and every (n/200-th) edge of the mainlands."""
    sides = roles(areas(vertices)).where("role is not null").select("doc_id", "contour_id", "role", F.greatest(F.lit(1), F.floor(F.col("n") / 200)).alias("step"))
    points = edges(vertices).join(sides, ["doc_id", "contour_id"]).where(F.col("seq") % F.col("step") == 0)
    island = points.where("role = 'island'").select("doc_id", "contour_id", "seq", "x", "y")
    shore = points.where("role = 'mainland'").select("doc_id", F.col("contour_id").alias("mainland"), F.col("seq").alias("edge"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"))
    return island, shore


def _feet(both: DataFrame) -> DataFrame:
    f = both.withColumn("f", foot(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))))
    return f.select("doc_id", "contour_id", "mainland", "seq", "edge", "x", "y", F.col("f.x").alias("fx"), F.col("f.y").alias("fy"), F.round("f.d2", 9).alias("d2"))


def candidates(vertices: DataFrame) -> DataFrame:
    """All bridges from vertices of an island to the nearest points of edges of the mainland, for inspection; ``shortest_clear`` makes no such table."""
    island, shore = _ends(vertices)
    return _feet(island.join(shore, "doc_id"))


def extents(vertices: DataFrame) -> DataFrame:
    """(doc_id, low_x, low_y, size): where a document's grid of CELLS x CELLS begins, and how wide its cells are."""
    sides = vertices.groupBy("doc_id").agg(F.min("x").alias("low_x"), F.min("y").alias("low_y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("wide"))
    return sides.select("doc_id", "low_x", "low_y", F.when(F.col("wide") > 0, F.col("wide") / CELLS).otherwise(1.0).alias("size"))


def _columns_and_rows(ends: tuple[str, str, str, str], scale: int) -> tuple[Column, Callable[[Column], Column]]:
    """The columns of cells that a segment passes, and a function of a column to the rows that it passes in it."""
    x1, y1, x2, y2 = (F.col(c) for c in ends)
    side = F.col("size") * scale
    column = lambda v: F.floor((v - F.col("low_x")) / side)
    row = lambda v: F.floor((v - F.col("low_y")) / side)
    slope = F.when(x1 != x2, (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0)))
    at = lambda x: y1 + (x - x1) * slope

    def rows(cx: Column) -> Column:
        left, right = F.greatest(F.least(x1, x2), F.col("low_x") + cx * side), F.least(F.greatest(x1, x2), F.col("low_x") + (cx + 1) * side)
        bottom = F.coalesce(F.greatest(F.least(at(left), at(right)), F.least(y1, y2)), F.least(y1, y2)) - F.lit(1e-6)
        top = F.coalesce(F.least(F.greatest(at(left), at(right)), F.greatest(y1, y2)), F.greatest(y1, y2)) + F.lit(1e-6)
        return F.sequence(row(bottom), row(top))

    return F.sequence(column(F.least(x1, x2)), column(F.greatest(x1, x2))), rows


def passed(ends: tuple[str, str, str, str], scale: int = 1) -> Column:
    """array<struct<cx,cy>>: the cells that a segment passes, column by column; for short segments, (low_x, low_y, size) beside them."""
    columns, rows = _columns_and_rows(ends, scale)
    return F.flatten(F.transform(columns, lambda cx: F.transform(rows(cx), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def in_cells(segments: DataFrame, extent: DataFrame, ends: tuple[str, str, str, str], scale: int = 1) -> DataFrame:
    """``segments`` (ends x1, y1, x2, y2) once for each cell (cx, cy) of their document's grid that they pass.

    What meets shares a cell, so joins by (doc_id, cx, cy) compare neighbours, and a large document isn't one key. ``scale``: cells of so
    many times the side.
    """
    columns, rows = _columns_and_rows(ends, scale)
    return segments.join(extent, "doc_id").withColumn("cx", F.explode(columns)).withColumn("cy", F.explode(rows(F.col("cx")))).drop("low_x", "low_y", "size")


def clear(found: DataFrame, walls: DataFrame, extent: DataFrame, margin: float = 1e-4) -> DataFrame:
    """Candidates that cross no third contour. ``walls``: edges (doc_id, _c, wx, wy, vx, vy) in the cells (cx, cy) that they pass.

    A candidate first meets the walls of the cell that it begins in, up to the first one that it crosses; only what is left goes through
    all its cells. Where contours are crowded nearly all end in the first step, so that the work doesn't grow with candidates times cells.
    """
    hit = cross(tuple(F.col(c) for c in ("x", "y", "fx", "fy")), tuple(F.col(c) for c in ("wx", "wy", "vx", "vy")), margin)
    here = lambda df, names: [df[a] == walls[b] for a, b in zip(names, ("doc_id", "cx", "cy"), strict=True)]
    place = lambda v, low: F.floor((F.col(v) - F.col(low)) / F.col("size"))
    begun = found.join(extent, "doc_id").withColumn("_x", place("x", "low_x")).withColumn("_y", place("y", "low_y")).drop("low_x", "low_y", "size")
    left = _saved(begun.join(walls, [*here(begun, ("doc_id", "_x", "_y")), begun["contour_id"] != walls["_c"], begun["mainland"] != walls["_c"], hit], "left_anti"))
    met = in_cells(left, extent, ("x", "y", "fx", "fy")).where((F.col("cx") != F.col("_x")) | (F.col("cy") != F.col("_y")))
    key = ["doc_id", "contour_id", "seq", "edge"]
    crossing = met.join(walls, [*here(met, ("doc_id", "cx", "cy")), met["contour_id"] != walls["_c"], met["mainland"] != walls["_c"], hit], "left_semi").select(*key).distinct()
    return left.drop("_x", "_y").join(crossing, key, "left_anti")


def walls_of(vertices: DataFrame, extent: DataFrame) -> DataFrame:
    walls = edges(vertices).select("doc_id", F.col("contour_id").alias("_c"), F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("nx").alias("vx"), F.col("ny").alias("vy"))
    return in_cells(walls, extent, ("wx", "wy", "vx", "vy"))


def crossings(vertices: DataFrame, margin: float, few: int = 32, block: int = 2000) -> DataFrame:
    """(doc_id, c1, c2, n): how many edges of two contours of a document cross.

    Contours of at most ``few`` vertices are dealt whole to the cells that their boxes pass, and a pair is compared in the first cell of
    both alone, so no pair is shuffled: crowded documents have far more pairs than contours. Pairs with a larger contour go edge by edge.
    """
    known = _saved(vertices.where("doc_id is not null and contour_id is not null").select("doc_id", "contour_id", "seq", "x", "y"))
    key = ["doc_id", "contour_id"]
    large = known.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select(*key)
    if large.isEmpty():
        return _crossings_of_contours(known, margin, block)
    large = _saved(large)
    pairs = _crossings_by_edges(known.join(large.withColumn("big", F.lit(True)), key, "left").withColumn("big", F.coalesce("big", F.lit(False))), margin)
    return _crossings_of_contours(known.join(large, key, "left_anti"), margin, block).unionByName(pairs)


def _crossings_by_edges(vertices: DataFrame, margin: float) -> DataFrame:
    """Of pairs of which one is ``big`` at least. A pair of edges that shares several cells counts in the first of them alone, so only counts of pairs of contours are dealt out again."""
    extent = extents(vertices)

    def side(k: int) -> DataFrame:
        own = edges(vertices).select("doc_id", F.col("contour_id").alias(f"c{k}"), F.col("big").alias(f"big{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("x", "y", "nx", "ny")))
        return own.join(extent, "doc_id").withColumn(f"p{k}", passed((f"x{k}", f"y{k}", f"nx{k}", f"ny{k}"))).drop("low_x", "low_y", "size").withColumn("_p", F.explode(f"p{k}")).withColumn("cx", F.col("_p.cx")).withColumn("cy", F.col("_p.cy")).drop("_p")

    hit = cross(*(tuple(F.col(f"{c}{k}") for c in ("x", "y", "nx", "ny")) for k in (1, 2)), margin)
    met = side(1).join(side(2), ["doc_id", "cx", "cy"]).where((F.col("c1") < F.col("c2")) & (F.col("big1") | F.col("big2")) & hit)
    once = met.where(F.array_intersect("p1", "p2")[0] == F.struct("cx", "cy"))
    return once.groupBy("doc_id", "c1", "c2").agg(F.count("*").alias("n"))


def _crossings_of_contours(vertices: DataFrame, margin: float, block: int) -> DataFrame:
    """Of pairs of small contours. Cells are as wide as a document's contours by the mean square, so a contour has some four of them; those of over ``block`` contours are dealt out by pairs of blocks."""
    ends = [f(c).alias(n) for c in "xy" for f, n in ((F.min, f"{c}0"), (F.max, f"{c}1"))]
    rings = vertices.groupBy("doc_id", "contour_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("v"), *ends)
    rings = _saved(rings.select("doc_id", "contour_id", F.col("v.x").alias("vx"), F.col("v.y").alias("vy"), "x0", "x1", "y0", "y1"))
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    grid = rings.groupBy("doc_id").agg(F.min("x0").alias("low_x"), F.min("y0").alias("low_y"), F.sqrt(F.avg((wide * wide + high * high) / 2)).alias("size"))
    grid = grid.withColumn("size", F.when(F.col("size") > 0, F.col("size")).otherwise(1.0))
    place = lambda v: F.floor((F.col(v) - F.col(f"low_{v[0]}")) / F.col("size"))
    spots = rings.join(grid, "doc_id").withColumns({"fx": place("x0"), "fy": place("y0"), "lx": place("x1"), "ly": place("y1")})
    placed = spots.withColumn("cx", F.explode(F.sequence("fx", "lx"))).withColumn("cy", F.explode(F.sequence("fy", "ly"))).drop("low_x", "low_y", "size", "lx", "ly")
    crowded = _saved(placed.groupBy("doc_id", "cx", "cy").agg(F.ceil(F.count("*") / block).alias("k")).where("k > 1"), small=True)
    dealt = placed.withColumns({"own": F.lit(0).cast("long"), "lo": F.lit(0).cast("long"), "hi": F.lit(0).cast("long")})
    if not crowded.isEmpty():
        own = placed.join(crowded, ["doc_id", "cx", "cy"], "left").withColumn("k", F.coalesce("k", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("contour_id"), "k"))
        dealt = own.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).withColumns({"lo": F.least("own", "_o"), "hi": F.greatest("own", "_o")}).drop("_o", "k")
    group = ["doc_id", "cx", "cy", "lo", "hi"]

    def run(some: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches.whole_groups((b for b in some if len(b)), group, batches.ROWS):
            yield from _crossing_pairs(rows, batches.starts(rows, group), margin)

    parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *group).sortWithinPartitions(*group, "contour_id").mapInPandas(run, "doc_id long, c1 long, c2 long, n long")


def _crossing_pairs(rows: pd.DataFrame, starts: np.ndarray, margin: float, most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Pairs of contours of a cell that cross, ``most`` pairs at a time; rows are sorted by cell and contour."""
    sizes = rows["vx"].map(len).to_numpy()
    at = np.arange(int(sizes.max())) < sizes[:, None]

    def padded(name: str) -> tuple[np.ndarray, np.ndarray]:
        """The edges' begins and ends; those past a ring's last are points, which cross nothing."""
        flat = np.concatenate(rows[name].to_numpy())
        first = np.cumsum(sizes) - sizes
        then = np.append(flat[1:], 0.0)
        then[first + sizes - 1] = flat[first]
        begin, end = np.zeros(at.shape), np.zeros(at.shape)
        begin[at], end[at] = flat, then
        return begin, end

    (ax, bx), (ay, by) = padded("vx"), padded("vy")
    dx, dy = bx - ax, by - ay
    doc, contour, fx, fy, cx, cy, own, lo, hi, x0, x1, y0, y1 = (rows[c].to_numpy() for c in ("doc_id", "contour_id", "fx", "fy", "cx", "cy", "own", "lo", "hi", "x0", "x1", "y0", "y1"))
    ends = np.repeat(np.append(starts[1:], len(rows)), np.diff(np.append(starts, len(rows))))
    partners = ends - np.arange(len(rows)) - 1
    cuts = np.searchsorted(np.cumsum(partners), np.arange(most, partners.sum(), most)) + 1
    step = max(1, (1 << 18) // at.shape[1] ** 2)
    for some in np.split(np.arange(len(rows)), np.unique(cuts)):
        n = partners[some]
        i = np.repeat(some, n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        here = (np.maximum(fx[i], fx[j]) == cx[i]) & (np.maximum(fy[i], fy[j]) == cy[i]) & ((lo[i] == hi[i]) | (own[i] != own[j]))
        here &= (x0[i] <= x1[j]) & (x0[j] <= x1[i]) & (y0[i] <= y1[j]) & (y0[j] <= y1[i])
        i, j = i[here], j[here]
        found = np.zeros(len(i), np.int64)
        for a in range(0, len(i), step):
            k, m = i[a : a + step], j[a : a + step]
            ux, uy, vx, vy = dx[k][:, :, None], dy[k][:, :, None], dx[m][:, None], dy[m][:, None]
            wx, wy = ax[m][:, None] - ax[k][:, :, None], ay[m][:, None] - ay[k][:, :, None]
            det = ux * vy - uy * vx
            with np.errstate(divide="ignore", invalid="ignore"):
                t, u = (wx * vy - wy * vx) / det, (wx * uy - wy * ux) / det
                hit = (np.abs(det) >= 1e-10) & (t > margin) & (t < 1 - margin) & (u > margin) & (u < 1 - margin)
            found[a : a + step] = hit.sum((1, 2))
        cut = found > 0
        yield pd.DataFrame({"doc_id": doc[i[cut]], "c1": contour[i[cut]], "c2": contour[j[cut]], "n": found[cut]})


def shortest_clear(vertices: DataFrame, first: int = 8, scales: tuple[int, ...] = (16, CELLS)) -> DataFrame:
    """The shortest clear bridge of each island, nearest feet first.

    Edges of the mainland, a few hundred a document, are dealt to the nine cells around each that they pass, in ever wider cells, so a
    vertex meets each of them once, and all feet within a cell's side are known. These are tested in order of length, ``first`` of each island and then the others. Islands that have their bridge look and test no
    more, so that only islands that are blocked all around reach all edges.
    """
    vertices = _saved(vertices)
    extent = _saved(extents(vertices), small=True)
    island, shore = (_saved(x) for x in _ends(vertices))
    walls = _saved(walls_of(vertices, extent))
    order = Window.partitionBy("doc_id", "contour_id").orderBy("d2", "seq", "edge")
    nine = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    done, before = [], -1.0
    for scale in scales:
        whole = scale == scales[-1]
        side = F.col("size") * scale
        own = island.join(extent, "doc_id").withColumn("cx", F.floor((F.col("x") - F.col("low_x")) / side)).withColumn("cy", F.floor((F.col("y") - F.col("low_y")) / side)).drop("low_x", "low_y", "size")
        reached = in_cells(shore, extent, ("ax", "ay", "bx", "by"), scale).withColumn("_o", F.explode(nine)).withColumn("cx", F.col("cx") + F.col("_o.a")).withColumn("cy", F.col("cy") + F.col("_o.b")).drop("_o").distinct()
        met = own.join(reached, ["doc_id", "cx", "cy"]).drop("cx", "cy")
        sized = _feet(met).join(extent.select("doc_id", "size"), "doc_id")
        reach = lambda k: F.col("size") * F.col("size") * float(k * k)
        near = sized if before < 0 else sized.where(F.col("d2") > reach(before))
        near = (near if whole else near.where(F.col("d2") <= reach(scale))).drop("size")
        ranked = _saved(near.withColumn("_r", F.row_number().over(order)))
        for some in (ranked.where(F.col("_r") <= first), ranked.where(F.col("_r") > first)):
            if done:
                some = some.join(done[-1].select("doc_id", "contour_id"), ["doc_id", "contour_id"], "left_anti")
            done.append(_saved(shortest(clear(some.drop("_r"), walls, extent))))
        before = scale
        if not whole:
            for found in done[-2:]:
                island = island.join(found.select("doc_id", "contour_id"), ["doc_id", "contour_id"], "left_anti")
            island = _saved(island)
            if island.isEmpty():
                break
    return reduce(DataFrame.unionByName, done)


def shortest(found: DataFrame) -> DataFrame:
    """The shortest bridge of each island; of equals the one of the first vertex and edge."""
    w = Window.partitionBy("doc_id", "contour_id").orderBy("d2", "seq", "edge")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def bridge_rectangle(width: float) -> Column:
    """Four corners around (x, y) -> (fx, fy); null if that is shorter than 1e-6."""
    dx, dy = F.col("fx") - F.col("x"), F.col("fy") - F.col("y")
    length = F.sqrt(dx * dx + dy * dy)
    nx, ny = -dy / length * (width / 2), dx / length * (width / 2)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, fx, fy = (F.col(c) for c in ("x", "y", "fx", "fy"))
    return F.when(length >= 1e-6, F.array(corner(x + nx, y + ny), corner(fx + nx, fy + ny), corner(fx - nx, fy - ny), corner(x - nx, y - ny)))


def shown(v: Column) -> Column:
    """A coordinate with two decimals, without trailing zeros."""
    hundredths = F.floor(v * 100 + 0.5).cast("long")
    size = F.abs(hundredths)
    whole, rest = F.floor(size / 100).cast("long").cast("string"), F.lpad((size % 100).cast("string"), 2, "0")
    text = F.concat(F.when(hundredths < 0, "-").otherwise(""), whole, F.lit("."), rest)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def path_of(points: Column) -> Column:
    """M x y L x y ... Z of an array of points; empty for none."""
    pairs = F.transform(points, lambda p: F.concat(shown(p["x"]), F.lit(" "), shown(p["y"])))
    return F.when(F.size(points) == 0, "").otherwise(F.concat(F.lit("M "), F.array_join(pairs, " L "), F.when(F.size(points) == 1, "  Z").otherwise(" Z")))


def ring_arrays(vertices: DataFrame) -> DataFrame:
    """(doc_id, contour_id, points) in order."""
    listed = vertices.groupBy("doc_id", "contour_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    return listed.select("doc_id", "contour_id", F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("points"))


def bridged_paths(vertices: DataFrame, width: float = 3, tolerance: float = 0) -> DataFrame:
    """(doc_id, place, d): paths of all contours and bridges of a document; painted in one fill they are the union.

    With a ``tolerance`` bridges are searched between simplified contours; the contours themselves stay as they are.
    """
    full = vertices
    vertices = simplify(vertices, tolerance) if tolerance > 0 else vertices
    shapes = ring_arrays(full).select("doc_id", F.concat(F.lit("c"), F.lpad(F.col("contour_id").cast("string"), 19, "0")).alias("place"), path_of(F.col("points")).alias("d"))
    joins = shortest_clear(vertices).withColumn("box", bridge_rectangle(width)).where("box is not null")
    return shapes.unionByName(joins.select("doc_id", F.concat(F.lit("x"), F.lpad(F.col("contour_id").cast("string"), 19, "0")).alias("place"), path_of(F.col("box")).alias("d")))


def documents(found: DataFrame, heads: DataFrame, fill: str = "black") -> DataFrame:
    """(doc_id, svg): paths (doc_id, place, d) in documents that keep viewBox, width, height and marker group of (doc_id, svg)."""
    body = found.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "d"))), lambda p: F.concat(F.lit('<path d="'), p["d"], F.lit(f'" fill="{fill}" fill-rule="evenodd"/>'))), "").alias("body"))
    part = lambda p: F.regexp_extract("svg", p, 0)
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" '), F.concat_ws(" ", *(F.nullif(part(p), F.lit("")) for p in (r'viewBox="[^"]*"', r'width="[^"]*"', r'height="[^"]*"'))), F.lit(">"))
    return heads.join(body, "doc_id").select("doc_id", F.concat(head, "body", part(r'(?s)<g id="corner-markers">.*?</g>'), F.lit("</svg>")).alias("svg"))
