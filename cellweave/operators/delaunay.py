"""Delaunay graphs of point sets of any size, by tiles.

A tile triangulates its own points with those of the eight tiles around it and the extreme points of the whole set. A
triangle of an own point is right if no point of the whole set lies inside its circumcircle, an edge of the tile's hull if
none lies beyond it. Where circle or half-plane reaches out of what the tile has seen, the cells that it covers are joined
with the points, in a box around the tile that doubles each time nothing is found; a point found inside joins the tile,
which triangulates again. A tile is done when all circles and half-planes of its own points are empty.

Points on one circle have no unique triangulation, so coordinates are moved by a hash of the id, by a billionth of the
extent at most. Of points at one place that with the smallest id takes part, the others have no edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.storage import cut

#: Points of a tile, about; where some tile holds CROWD times as many, tiles get smaller.
TILE, CROWD = 64, 8
SHAKE = 1e-9
ROUNDS = 500


def _ghostly(t: tuple[int, int, int]) -> tuple[int, int, int]:
    """A triangle with the point at infinity (-1), if it has it, last."""
    return t if t[0] >= 0 and t[1] >= 0 else (t[1], t[2], t[0]) if t[0] < 0 else (t[2], t[0], t[1])


def _form(x: np.ndarray, y: np.ndarray, t: tuple[int, int, int]) -> tuple[float, float, float, float]:
    """(p, q, r, s): points with p (x² + y²) + q x + r y + s < 0 lie inside the circumcircle, or beyond the hull's edge."""
    a, b, c = t
    if c < 0:
        dx, dy = x[b] - x[a], y[b] - y[a]
        return 0.0, dy, -dx, dx * y[a] - dy * x[a]
    ax, ay, bx, by, cx, cy = x[a], y[a], x[b], y[b], x[c], y[c]
    aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    xy = bx * cy - by * cx
    yz, xz = bb * cy - by * cc, bb * cx - bx * cc
    return (
        ax * (by - cy) - ay * (bx - cx) + xy,
        -(aa * (by - cy) - ay * (bb - cc) + yz),
        aa * (bx - cx) - ax * (bb - cc) + xz,
        -(aa * xy - ax * yz + ay * xz),
    )


def triangulate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triangles, forms) of points in general position, by insertion; hull edges are triangles whose third corner is -1."""
    n = len(x)
    if n < 3:
        return np.empty((0, 3), np.int64), np.empty((0, 4))
    turn = (x[1] - x[0]) * (y[2] - y[0]) - (y[1] - y[0]) * (x[2] - x[0])
    a, b, c = (0, 1, 2) if turn > 0 else (0, 2, 1)
    lift = np.stack([x * x + y * y, x, y, np.ones(n)])
    corners, forms, alive, used = np.empty((8 * n + 16, 3), np.int64), np.empty((8 * n + 16, 4)), np.zeros(8 * n + 16, bool), 0

    def add(t: tuple[int, int, int]) -> None:
        nonlocal used, corners, forms, alive
        if used == len(corners):
            corners, forms, alive = (np.concatenate([z, np.zeros_like(z)]) for z in (corners, forms, alive))
        t = _ghostly(t)
        corners[used], forms[used], alive[used] = t, _form(x, y, t), True
        used += 1

    for t in ((a, b, c), (b, a, -1), (c, b, -1), (a, c, -1)):
        add(t)
    for k in range(3, n):
        hit = np.flatnonzero(alive[:used] & (forms[:used] @ lift[:, k] < 0))
        if not len(hit):
            continue
        alive[hit] = False
        edges = {e for t in corners[hit].tolist() for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        for u, v in edges:
            if (v, u) not in edges:
                add((u, v, k))
        if used > 4096 and used > 6 * alive[:used].sum():
            kept = np.flatnonzero(alive[:used])
            used = len(kept)
            corners[:used], forms[:used] = corners[kept], forms[kept]
            alive[:used], alive[used:] = True, False
    return corners[:used][alive[:used]], forms[:used][alive[:used]]


def _reach(form: np.ndarray, box: tuple[float, float, float, float]) -> tuple[float, float, float, float] | None:
    """Bounds of the part of ``box`` (x0, x1, y0, y1) that a form's inside may meet."""
    p, q, r, s = form
    x0, x1, y0, y1 = box
    if p > 0:
        cx, cy = -q / (2 * p), -r / (2 * p)
        radius = np.sqrt(max(0.0, cx * cx + cy * cy - s / p)) * (1 + 1e-9)
        out = max(x0, cx - radius), min(x1, cx + radius), max(y0, cy - radius), min(y1, cy + radius)
        return out if out[0] <= out[1] and out[2] <= out[3] else None
    ring, inside = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)], []
    value = [q * x + r * y + s for x, y in ring]
    for k in range(4):
        (ax, ay), (bx, by), a, b = ring[k], ring[(k + 1) % 4], value[k], value[(k + 1) % 4]
        if a <= 0:
            inside.append((ax, ay))
        if (a < 0) != (b < 0):
            inside.append((ax + (bx - ax) * a / (a - b), ay + (by - ay) * a / (a - b)))
    if not inside:
        return None
    xs, ys = zip(*inside, strict=True)
    return min(xs), max(xs), min(ys), max(ys)


def _meets(form: np.ndarray, box: tuple[float, float, float, float]) -> bool:
    """Whether some point of the box is inside the form: the nearest to the centre, or a corner."""
    p, q, r, s = form
    x0, x1, y0, y1 = box
    if p > 0:
        x, y = min(max(-q / (2 * p), x0), x1), min(max(-r / (2 * p), y0), y1)
        return p * (x * x + y * y) + q * x + r * y + s < 0
    return min(q * x0, q * x1) + min(r * y0, r * y1) + s < 0


TRIED = "tx long, ty long, probe int, a {t}, b {t}, c {t}, ox double, oy double, p double, q double, r double, s double, covered boolean, flat boolean, cells array<struct<cx:long,cy:long>>"


def _tried(blocks: DataFrame, kind: str, bounds: tuple, h: float, shake: float) -> DataFrame:
    """Triangles and hull edges of each tile's own points, each with the cells that it has still to be compared with; flat: on a line but for the shake."""
    x0, x1, y0, y1 = bounds

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        tx, ty, t = int(key[0]), int(key[1]), int(g["t"].iloc[0])
        g = g.sort_values("obs_id").drop_duplicates("obs_id")
        order = np.random.default_rng(0).permutation(len(g))
        ids, own = g["obs_id"].to_numpy()[order], ((g["cx"] == tx) & (g["cy"] == ty)).to_numpy()[order]
        ox, oy = x0 + (tx + 0.5) * h, y0 + (ty + 0.5) * h
        x, y = g["x"].to_numpy(float)[order] - ox, g["y"].to_numpy(float)[order] - oy
        corners, forms = triangulate(x, y)
        whole, near = (x0 - ox, x1 - ox, y0 - oy, y1 - oy), 1.5 * h
        far, side = h * (0.5 + 2.0**t), h * 2.0**t / 2
        box = (max(whole[0], -far), min(whole[1], far), max(whole[2], -far), min(whole[3], far))
        rows = []
        for k in np.flatnonzero((own[corners] & (corners >= 0)).any(axis=1)).tolist():
            form, cells, covered = forms[k], [], True
            reach = _reach(form, whole)
            if reach is not None and max(-reach[0], reach[1], -reach[2], reach[3]) > near:
                covered = t > 0 and (max(-reach[0], reach[1], -reach[2], reach[3]) <= far or box == whole)
                part = _reach(form, box) if t else None
                if part is not None:
                    low = [int(np.floor((v + o - z) / side)) for v, o, z in ((part[0], ox, x0), (part[1], ox, x0), (part[2], oy, y0), (part[3], oy, y0))]
                    for i in range(low[0], low[1] + 1):
                        for j in range(low[2], low[3] + 1):
                            cell = (x0 + i * side - ox, x0 + (i + 1) * side - ox, y0 + j * side - oy, y0 + (j + 1) * side - oy)
                            seen = max(abs(cell[0]), abs(cell[1]), abs(cell[2]), abs(cell[3])) <= near
                            if not seen and _meets(form, cell):
                                cells.append((i, j))
            a, b, c = (ids[v] if v >= 0 else None for v in corners[k].tolist())
            longest = max(np.hypot(x[u] - x[v], y[u] - y[v]) for u, v in zip(corners[k], np.roll(corners[k], 1), strict=True))
            rows.append((tx, ty, k, a, b, c, ox, oy, *forms[k].tolist(), bool(covered), bool(form[0] <= 2 * shake * longest), cells))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TRIED.split(", ")])

    return blocks.groupBy("tx", "ty").applyInPandas(run, TRIED.format(t=kind))


def _table(df: DataFrame) -> DataFrame:
    """``df`` cut; tables of points, tiles and triangles meet by merges, never by copies that pass the driver."""
    return cut(df).hint("merge")


def triangles(points: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b, c) of the Delaunay triangles of ``points`` (obs_id, x, y), a < b < c; rows without finite coordinates are left out."""
    spark, kind = points.sparkSession, dict(points.dtypes)["obs_id"]
    finite = "x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')"
    p = points.where(finite).groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("obs_id").alias("obs_id"))
    lows = p.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n, x0, x1, y0, y1 = lows
    none = spark.createDataFrame([], f"a {kind}, b {kind}, c {kind}")
    if n < 3:
        return none
    shake = SHAKE * max(x1 - x0, y1 - y0)
    moved = lambda c, seed: F.col(c) + shake * (F.pmod(F.xxhash64("obs_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) - 0.5)
    p = _table(p.select("obs_id", moved("x", 1).alias("x"), moved("y", 2).alias("y")))
    x0, x1, y0, y1 = p.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    side = max(x1 - x0, y1 - y0)
    h = max(np.sqrt(max((x1 - x0) * (y1 - y0), side * side / n) * tile / n), side / 1e6)
    cells = lambda s: (F.floor((F.col("x") - x0) / s).alias("cx"), F.floor((F.col("y") - y0) / s).alias("cy"))
    while n > CROWD * tile and h > side / 1e9 and p.groupBy(*cells(h)).count().agg(F.max("count")).first()[0] > CROWD * tile:
        h /= 2
    ways = [F.col("x") * a + F.col("y") * b for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))]
    extreme = p.agg(*[F.max_by(F.struct("obs_id", "x", "y"), w).alias(f"e{k}") for k, w in enumerate(ways)]).first()
    always = spark.createDataFrame(sorted({tuple(e) for e in extreme}), f"obs_id {kind}, x double, y double")  # eight rows at most
    placed = _table(p.select("obs_id", "x", "y", *cells(h)))
    around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    spread = placed.withColumn("i", around).withColumn("j", around).select("obs_id", "x", "y", "cx", "cy", (F.col("cx") + F.col("i")).alias("tx"), (F.col("cy") + F.col("j")).alias("ty"))
    tiles = _table(placed.select(F.col("cx").alias("tx"), F.col("cy").alias("ty")).distinct().withColumn("t", F.lit(0)))
    extra = _table(tiles.select("tx", "ty").join(F.broadcast(always)).select("tx", "ty", "obs_id", "x", "y"))
    done = none
    for _ in range(ROUNDS):
        late = extra.join(placed.select("obs_id", "cx", "cy"), "obs_id").select("obs_id", "x", "y", "cx", "cy", "tx", "ty")
        blocks = spread.unionByName(late).join(tiles, ["tx", "ty"])
        tried = _table(_tried(blocks, kind, (x0, x1, y0, y1), h, shake))
        levels = [r[0] for r in tiles.select("t").distinct().where("t > 0").collect()]  # as many as doublings of a tile in the extent
        found = None
        for t in levels:
            asked = tried.join(tiles.where(F.col("t") == t), ["tx", "ty"]).where(F.size("cells") > 0).withColumn("cell", F.explode("cells")).select("*", "cell.cx", "cell.cy").drop("cells", "cell")
            met = asked.join(p.select(F.col("obs_id").alias("k"), F.col("x").alias("kx"), F.col("y").alias("ky"), *cells(h * 2.0**t / 2)), ["cx", "cy"])
            dx, dy = F.col("kx") - F.col("ox"), F.col("ky") - F.col("oy")
            inside = (F.col("p") * (dx * dx + dy * dy) + F.col("q") * dx + F.col("r") * dy + F.col("s") < 0) & ~(F.col("k").eqNullSafe(F.col("a")) | F.col("k").eqNullSafe(F.col("b")) | F.col("k").eqNullSafe(F.col("c")))
            new = met.where(inside).groupBy("tx", "ty", "probe").agg(F.min_by(F.struct(F.col("k").alias("obs_id"), F.col("kx").alias("x"), F.col("ky").alias("y")), F.struct(dx * dx + dy * dy, F.col("k"))).alias("m")).select("tx", "ty", "m.*")
            found = new if found is None else found.unionByName(new)
        if found is not None:
            found = _table(found.distinct().join(extra.select("tx", "ty", "obs_id"), ["tx", "ty", "obs_id"], "left_anti"))
            extra = extra.unionByName(found)
        changed = (tiles.where("false") if found is None else found).select("tx", "ty").distinct().withColumn("changed", F.lit(True))
        covered = tried.groupBy("tx", "ty").agg(F.min("covered").alias("covered"))
        state = _table(tiles.join(changed, ["tx", "ty"], "left").join(covered, ["tx", "ty"], "left").na.fill({"changed": False, "covered": True}))
        settled = tried.join(state.where("covered and not changed"), ["tx", "ty"], "left_semi")
        full = settled.where("c is not null and not flat").select(F.array_sort(F.array("a", "b", "c")).alias("v")).select(F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), F.col("v")[2].alias("c"))
        done = done.unionByName(full)
        tiles = state.where("changed or not covered").select("tx", "ty", F.when(F.col("changed"), F.col("t")).otherwise(F.col("t") + 1).alias("t"))
        if tiles.isEmpty():
            return done.distinct()
    raise RuntimeError(f"tiles did not settle in {ROUNDS} rounds")


def delaunay_edges(points: DataFrame, tile: int = TILE) -> DataFrame:
    """(src, dst, d), src < dst: the edges of the Delaunay triangulation of ``points`` (obs_id, x, y)."""
    t = triangles(points, tile)
    pairs = t.select("a", "b").unionByName(t.select("a", F.col("c").alias("b"))).unionByName(t.select(F.col("b").alias("a"), F.col("c").alias("b"))).distinct()
    at = lambda end, x, y: points.select(F.col("obs_id").alias(end), F.col("x").cast("double").alias(x), F.col("y").cast("double").alias(y))
    both = pairs.join(at("a", "ax", "ay").hint("merge"), "a").join(at("b", "bx", "by").hint("merge"), "b")
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2).alias("d"))
