"""Spatial and expression graphs as edge tables (src, dst, d)."""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.storage import cut

#: Up to so many points, all pairs are scored against a broadcast copy (its size is counted first).
SMALL = 5000
#: Points of a tile, about; tiles of more than CROWD times as many get smaller; points of a task's share of a tile.
TILE, CROWD, SHARE = 256, 8, 4096


def _as_dst(points: DataFrame) -> DataFrame:
    return points.select(F.col("obs_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))


_D2 = "(x - x2) * (x - x2) + (y - y2) * (y - y2)"


def knn(points: DataFrame, k: int, include_self: bool = False, small: int | None = None) -> DataFrame:
    """(src, dst, d, rank): the k nearest points of each of ``points`` (obs_id, x, y), ties to the smaller id.

    Few points (up to ``small``, by default ``SMALL``): scored against a broadcast copy. Many: points fall into tiles, made
    smaller until none is crowded, and meet those of the tile and a margin around it; points whose k-th neighbour may lie
    beyond go on to tiles of four times the side. A tile of many points is dealt out by shares, each against each, so a task
    holds a bounded number of points. Every row with finite coordinates takes part; a point set of one gives no edges.
    """
    points = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n, x0, x1, y0, y1 = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    apart = F.lit(True) if include_self else F.col("src") != F.col("dst")
    w = Window.partitionBy("src").orderBy("d2", "dst")
    best = lambda pairs: pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if n <= (SMALL if small is None else small):
        near = best(points.withColumnRenamed("obs_id", "src").join(F.broadcast(_as_dst(points)), apart).withColumn("d2", F.expr(_D2)))
        return near.select("src", "dst", F.sqrt("d2").alias("d"), "rank")
    points, kind = points.where("obs_id is not null"), dict(points.dtypes)["obs_id"]
    side = max((x1 - x0), (y1 - y0), 1e-12)
    h = max(math.sqrt(max((x1 - x0) * (y1 - y0), side * side / n) * max(TILE, 16 * k) / n), side / 1e6)
    home = lambda h: (F.floor((F.col("x") - x0) / h).alias("tx"), F.floor((F.col("y") - y0) / h).alias("ty"))
    while h > side / 1e9 and points.groupBy(*home(h)).count().agg(F.max("count")).first()[0] > CROWD * max(TILE, 16 * k):
        h /= 2
    todo, done = points, []
    while True:
        margin, (tx, ty) = h / 4, home(h)
        reach = lambda c, c0: F.explode(F.sequence(F.floor((F.col(c) - c0 - margin) / h), F.floor((F.col(c) - c0 + margin) / h)))  # noqa: E731, B023
        around = points.withColumn("tx", reach("x", x0)).withColumn("ty", reach("y", y0))
        crowded = around.groupBy("tx", "ty").count().where(F.col("count") > SHARE).select("tx", "ty", F.ceil(F.col("count") / SHARE).cast("int").alias("shares"))
        dealt = lambda rows: rows.join(F.broadcast(crowded), ["tx", "ty"], "left").na.fill(1, ["shares"])  # noqa: E731, B023  a row for SHARE points
        mine, each = F.pmod(F.xxhash64("obs_id"), F.col("shares")).cast("int"), F.explode(F.expr("sequence(0, shares - 1)"))
        own = dealt(todo.select("*", tx, ty)).select("*", mine.alias("a"), F.lit(True).alias("own")).withColumn("b", each)
        near = dealt(around).select("*", mine.alias("b"), F.lit(False).alias("own")).withColumn("a", each)
        pairs = own.unionByName(near).drop("shares").groupBy("tx", "ty", "a", "b").applyInPandas(lambda g: _nearest(g, k, include_self), f"src {kind}, x double, y double, dst {kind}, d2 double")
        found = cut(best(pairs))
        if h > side:
            done.append(found)
            break
        fx, fy = (F.col("x") - x0) - tx * h, (F.col("y") - y0) - ty * h
        sure = margin + F.least(fx, h - fx, fy, h - fy) - 1e-6 * h
        ok = found.groupBy("src").agg(F.count("*").alias("n"), F.max("d2").alias("far"), F.first("x").alias("x"), F.first("y").alias("y"))
        ok = cut(ok.where((F.col("n") >= k) & (F.sqrt("far") < sure)).select("src"))
        done.append(found.join(ok.hint("merge"), "src", "left_semi"))
        todo = cut(todo.join(ok.withColumnRenamed("src", "obs_id").hint("merge"), "obs_id", "left_anti"))
        if todo.isEmpty():
            break
        h *= 4
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("src", "dst", F.sqrt("d2").alias("d"), "rank")


def _nearest(rows: pd.DataFrame, k: int, include_self: bool) -> pd.DataFrame:
    """(src, x, y, dst, d2): of a tile's rows that are not ``own`` the k nearest to each that is."""
    own, near = rows[rows["own"]], rows[~rows["own"]].sort_values("obs_id", kind="stable")
    ids, x, y = own["obs_id"].to_numpy(), own["x"].to_numpy(), own["y"].to_numpy()
    to, x2, y2 = near["obs_id"].to_numpy(), near["x"].to_numpy(), near["y"].to_numpy()
    out = {"src": [ids[:0]], "x": [x[:0]], "y": [y[:0]], "dst": [to[:0]], "d2": [x[:0]]}
    step = max(1, (1 << 20) // max(1, len(to)))
    for at in range(0, len(ids) if len(to) else 0, step):
        i, px, py = ids[at : at + step], x[at : at + step, None], y[at : at + step, None]
        d2 = (px - x2) * (px - x2) + (py - y2) * (py - y2)
        if not include_self:
            d2[i[:, None] == to] = np.inf
        bar = np.partition(d2, min(k, len(to)) - 1, axis=1)[:, min(k, len(to)) - 1]
        r, c = np.nonzero((d2 <= bar[:, None]) & (d2 < np.inf))
        d = d2[r, c]
        order = np.lexsort((d, r))  # stable: of equal distances the smaller id is first
        r, c, d = r[order], c[order], d[order]
        first = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
        r, c, d = r[first], c[first], d[first]
        for name, column in (("src", i[r]), ("x", px[r, 0]), ("y", py[r, 0]), ("dst", to[c]), ("d2", d)):
            out[name].append(column)
    return pd.DataFrame({name: pd.Series(np.concatenate(parts), dtype=parts[0].dtype) for name, parts in out.items()})


def radius_edges(points: DataFrame, radius: float) -> DataFrame:
    """(src, dst, d) of all ordered pairs of different points within ``radius``: an equi-join of grid cells of that side, then the exact distance."""
    cell = {"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)}
    around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    src = points.select(F.col("obs_id").alias("src"), "x", "y").withColumns(cell).withColumn("ox", around).withColumn("oy", around)
    src = src.select("src", "x", "y", (F.col("cx") + F.col("ox")).alias("cx"), (F.col("cy") + F.col("oy")).alias("cy"))
    dst = points.withColumns(cell).select(F.col("obs_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy")
    return src.join(dst, ["cx", "cy"]).where("src <> dst").withColumn("d2", F.expr(_D2)).where(F.col("d2") <= radius * radius).select("src", "dst", F.sqrt("d2").alias("d"))


def grid_ring_edges(spots: DataFrame, rings: int = 1) -> DataFrame:
    """(src, dst, ring) on a hexagonal lattice (obs_id, row, col), columns two apart on a row: neighbours up to ``rings`` steps."""
    offsets = [(dr, dc, max(abs(dr), (abs(dr) + abs(dc)) // 2)) for dr in range(-rings, rings + 1) for dc in range(-2 * rings, 2 * rings + 1) if (dr + dc) % 2 == 0 and (dr, dc) != (0, 0) and max(abs(dr), (abs(dr) + abs(dc)) // 2) <= rings]
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(r).alias("ring")) for a, b, r in offsets]))
    src = spots.select(F.col("obs_id").alias("src"), "row", "col", steps.alias("o")).select("src", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), F.col("o.ring").alias("ring"))
    return src.join(spots.select(F.col("obs_id").alias("dst"), "row", "col"), ["row", "col"]).select("src", "dst", "ring")


#: Numbers of a block of vectors at most; up to so many blocks hold fewer, so that there are pairs of blocks for all tasks.
BLOCK_CELLS, SMALL_CELLS, EVEN_BLOCKS = 1 << 22, 1 << 16, 8


def vector_blocks(numbers: int) -> int:
    """Blocks of so many numbers: every block meets every one, so few large ones move the least."""
    return max(1, -(-numbers // BLOCK_CELLS), min(EVEN_BLOCKS, -(-numbers // SMALL_CELLS)))


def vector_knn(vectors: DataFrame, k: int, per: str | None = None) -> DataFrame:
    """(src, dst, d, rank[, per]) of the k nearest rows of (obs_id, v[, per]) by Euclidean distance, within each value of ``per``.

    Blocks of rows of bounded size meet blocks of rows; a task takes the matrix product of a pair of blocks, measures the
    rows that it puts first anew, difference by difference, and keeps k of them a row. Ties go to the smaller id.
    """
    n, dims = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = vector_blocks(n * max(1, dims or 1))
    groups = [per] if per else []
    types = dict(vectors.dtypes)
    rows = vectors.select("obs_id", F.transform("v", lambda x: x.cast("double")).alias("v"), *groups, F.pmod(F.xxhash64("obs_id"), F.lit(blocks)).cast("int").alias("block"))
    packed = cut(rows.groupBy("block").agg(F.collect_list("obs_id").alias("ids"), F.collect_list("v").alias("v"), *[F.collect_list(per).alias("of") for _ in groups]))
    left = packed.select("ids", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("block").alias("own"))
    right = packed.select("block", F.col("ids").alias("to"), F.col("v").alias("w"), *(["of"] if per else []))
    pairs = left.join(right.hint("merge"), "block").repartition(blocks * blocks, "own", "block").drop("own")
    schema = f"src {types['obs_id']}, dst {types['obs_id']}, {f'{per} {types[per]}, ' if per else ''}d2 double"

    def nearest(ids, a, to, b, of):
        """Rows (src, dst, group, d2) of one pair of blocks."""
        out = []
        kinds, member = np.unique(of, return_inverse=True) if of is not None else (np.array([None], object), np.zeros(len(b), np.int64))
        bb = (b * b).sum(axis=1)
        step = max(16, min(512, (1 << 22) // max(1, len(b))))
        places: dict = {}
        for j, t in enumerate(to):
            places.setdefault(t, []).append(j)
        for g in range(len(kinds)):
            inside = np.flatnonzero(member == g)
            within = np.full(len(b), -1)
            within[inside] = np.arange(len(inside))
            for at in range(0, len(a), step):
                x = a[at : at + step]
                about = bb[inside][None] - 2 * x @ b[inside].T + (x * x).sum(axis=1)[:, None]
                own = [(i, within[j]) for i, t in enumerate(ids[at : at + step]) for j in places.get(t, ()) if within[j] >= 0]
                if own:
                    about[tuple(np.array(own).T)] = np.inf
                take = min(k, len(inside))
                bar = np.partition(about, take - 1, axis=1)[:, take - 1]
                slack = 1e-9 * (np.abs(bar) + (x * x).sum(axis=1) + bb[inside].max())
                for i in range(len(x)):
                    c = inside[np.flatnonzero((about[i] <= bar[i] + slack[i]) & (about[i] < np.inf))]
                    d2 = ((x[i] - b[c]) ** 2).sum(axis=1)
                    best = sorted(zip(d2.tolist(), (to[j] for j in c), strict=True))[:k]
                    out += [(ids[at + i], t, kinds[g], d) for d, t in best]
        return out

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, to = list(r.ids), list(r.to)
                got = nearest(ids, np.stack(r.v), to, np.stack(r.w), np.asarray(r.of) if per else None)
                yield pd.DataFrame({"src": [x[0] for x in got], "dst": [x[1] for x in got], **({per: [x[2] for x in got]} if per else {}), "d2": [x[3] for x in got]})

    near = pairs.mapInPandas(run, schema)
    w = Window.partitionBy("src", *groups).orderBy("d2", "dst")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", *groups, F.sqrt("d2").alias("d"), "rank")


def fuzzy_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of kNN edges with d: exp(-(d - nearest) / scale), the scale such that a row's weights sum to log2 of their
    number, joined with the reverse edge by a + b - ab. Grouped by src: k rows each."""
    kind = dict(edges.dtypes)["src"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows["d"].to_numpy(float)
        near = d[d > 0].min() if (d > 0).any() else 0.0
        past, goal = np.maximum(d - near, 0.0), np.log2(max(2, len(d)))
        low, high, scale = 0.0, np.inf, 1.0
        for _ in range(64):
            total = np.exp(-past / scale).sum()
            if abs(total - goal) < 1e-5:
                break
            if total > goal:
                high = scale
                scale = (low + high) / 2
            else:
                low = scale
                scale = scale * 2 if high == np.inf else (low + high) / 2
        scale = max(scale, 1e-3 * d.mean()) if d.mean() > 0 else scale
        return pd.DataFrame({"src": rows["src"], "dst": rows["dst"], "w": np.exp(-past / scale)})

    one = edges.select("src", "dst", "d").groupBy("src").applyInPandas(run, f"src {kind}, dst {kind}, w double")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    # a + b - ab of the one or two weights of a pair
    return both.groupBy("src", "dst").agg((F.sum("w") - F.when(F.count("*") > 1, F.max("w") * F.min("w")).otherwise(0.0)).alias("w"))


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of edges that exist both ways."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").join(back, ["src", "dst"]).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()


def row_standardised(edges: DataFrame) -> DataFrame:
    """(src, dst, w): each row's weights sum to one."""
    return edges.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("src")))


def combined(expression: DataFrame, spatial: DataFrame, spatial_weight: float) -> DataFrame:
    """(src, dst, w): (1 - s) times the expression graph plus s times the spatial graph; a weight of zero is zero."""
    parts = expression.select("src", "dst", (F.col("w") * (1.0 - spatial_weight)).alias("w")).unionByName(spatial.select("src", "dst", (F.col("w") * spatial_weight).alias("w")))
    return parts.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Undirected (a, b), a < b, each once."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()


def degree(edges: DataFrame) -> DataFrame:
    und = symmetric(edges)
    return und.select(F.col("a").alias("obs_id")).unionByName(und.select(F.col("b").alias("obs_id"))).groupBy("obs_id").agg(F.count("*").alias("degree"))


def clustering(edges: DataFrame) -> DataFrame:
    """(obs_id, degree, triangles, clustering): triangles by a three-way join on ordered pairs, so each counts once."""
    und = symmetric(edges)
    ab, bc, ac = und.select("a", "b"), und.select(F.col("a").alias("b"), F.col("b").alias("c")), und.select("a", F.col("b").alias("c"))
    tri = ab.join(bc, "b").join(ac, ["a", "c"])
    per_node = tri.select(F.explode(F.array("a", "b", "c")).alias("obs_id")).groupBy("obs_id").agg(F.count("*").alias("triangles"))
    d = degree(edges).join(per_node, "obs_id", "left").na.fill(0, ["triangles"])
    return d.withColumn("clustering", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def connected(edges: DataFrame, nodes: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(obs_id, component): the smallest id reachable, by large-star and small-star rounds on distinct pairs; nodes without edges are their own."""
    e = symmetric(edges).select(F.col("b").alias("u"), F.col("a").alias("v"))
    e, before = cut(e).hint("merge"), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()).hint("merge")
        now = e.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.select("obs_id").join(e.select(F.col("u").alias("obs_id"), F.col("v").alias("component")).hint("merge"), "obs_id", "left").withColumn("component", F.coalesce("component", "obs_id"))


def hops(edges: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, hops) for all reachable ordered pairs of an undirected graph: breadth-first frontiers as joins, until one is
    empty; an error if pairs lie further apart than ``max_depth``."""
    und = symmetric(edges)
    step = und.select(F.col("a").alias("dst"), F.col("b").alias("to")).unionByName(und.select(F.col("b").alias("dst"), F.col("a").alias("to")))
    step = cut(step)
    seen = cut(nodes.select(F.col("obs_id").alias("src"), F.col("obs_id").alias("dst"), F.lit(0).alias("hops")))
    front = seen
    for depth in count(1):
        front = cut(front.join(step, "dst").select("src", F.col("to").alias("dst")).distinct().join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(depth)))
        if front.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"nodes lie more than {max_depth} steps apart")
        seen = cut(seen.unionByName(front))
    return seen.where("hops > 0")
