"""Counts of pairs of points by distance and label, without a row for any pair.

Points are packed into blocks of bounded size, by place. Blocks near enough meet in a task, which cuts both into chunks of
neighbouring points: two chunks whose least and greatest distance fall into the same bin are counted by the product of
their numbers, only at the edges of bins are points measured one by one. A pair of blocks leaves a row for each pair of
labels and bin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.storage import cut

BLOCK, CHUNK = 16_384, 64
_SLACK = 1e-9


def _chunks(x: np.ndarray, y: np.ndarray, label: np.ndarray, labels: int) -> tuple:
    """(points in order, starts, bounds, numbers by label) of chunks of neighbouring points: strips by x, cut by y."""
    strip = max(1, int(np.sqrt(len(x) / CHUNK)))
    order = np.argsort(x, kind="stable")
    size = -(-len(x) // strip)
    order = np.concatenate([part[np.argsort(y[part], kind="stable")] for part in (order[k : k + size] for k in range(0, len(x), size))])
    starts = np.concatenate([np.arange(k, min(k + size, len(x)), CHUNK) for k in range(0, len(x), size)])
    x, y, label = x[order], y[order], label[order]
    bounds = np.stack([f.reduceat(v, starts) for v in (x, y) for f in (np.minimum, np.maximum)])
    counts = np.zeros((len(starts), labels))
    np.add.at(counts, (np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x)))), label), 1)
    return (x, y, label), np.append(starts, len(x)), bounds, counts


def bin_of(d: np.ndarray, width: float, bins: int, upper: bool) -> np.ndarray:
    """Bins from 1: a bin holds its upper edge if ``upper``, else its lower one; distance zero is in the first, the greatest in the last."""
    return np.maximum(1, np.ceil(d / width)).astype(np.int64) if upper else np.minimum(bins, np.floor(d / width) + 1).astype(np.int64)


def histogram(a: tuple, b: tuple, labels: int, top: float, bins: int, upper: bool) -> np.ndarray:
    """Pairs of a point of a and one of b (x, y, label code), within ``top``, by label of a, label of b and bin."""
    (ax, ay, al), at, ab, ac = _chunks(*a, labels)
    (bx, by, bl), bt, bb, bc = _chunks(*b, labels)
    width = top / bins
    out = np.zeros((labels, labels, bins + 1), np.int64)
    gap = lambda k: np.maximum(0, np.maximum(ab[k][:, None] - bb[k + 1][None], bb[k][None] - ab[k + 1][:, None]))
    span = lambda k: np.maximum(ab[k + 1][:, None] - bb[k][None], bb[k + 1][None] - ab[k][:, None])
    low, high = np.hypot(gap(0), gap(2)) * (1 - _SLACK), np.hypot(span(0), span(2)) * (1 + _SLACK)
    first, last = bin_of(low, width, bins, upper), bin_of(np.minimum(high, 2 * top), width, bins, upper)
    whole = (high < top) & (first == last) & ((low > 0) | (last == 1))
    for k in np.unique(first[whole]).tolist():
        mask = whole & (first == k)
        rows = np.flatnonzero(mask.any(axis=1))
        out[:, :, k] += np.rint(ac[rows].T @ (mask[rows] @ bc)).astype(np.int64)
    for i, j in zip(*np.nonzero(~whole & (low <= top)), strict=True):
        p, q = slice(at[i], at[i + 1]), slice(bt[j], bt[j + 1])
        dx, dy = ax[p][:, None] - bx[q][None], ay[p][:, None] - by[q][None]
        d2 = dx * dx + dy * dy
        d = np.sqrt(d2)
        near = d <= top if upper else d2 <= top * top
        code = (al[p][:, None] * labels + bl[q][None])[near] * (bins + 1) + bin_of(d[near], width, bins, upper)
        out += np.bincount(code, minlength=out.size).reshape(out.shape)
    return out


def pair_counts(points: DataFrame, top: float, bins: int, upper: bool, by: tuple[str, ...] = (), label: str | None = None, block: int = BLOCK) -> DataFrame:
    """(*by, [label_a, label_b,] bin, n) of ``points`` (obs_id, x, y, *by[, label]): ordered pairs of different rows of one
    set within ``top``. Labels are few: each task holds bins x labels squared numbers. Rows without finite coordinates are left out."""
    spark = points.sparkSession
    of = (F.col(label) if label else F.lit(0)).alias("_label")
    p = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(*by, "obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), of)
    names = [r[0] for r in p.select("_label").distinct().orderBy("_label").collect()] if label else [0]
    kind = dict(p.dtypes)["_label"]
    coded = spark.createDataFrame([(v, k) for k, v in enumerate(names) if v is not None], f"_label {kind}, code int")
    p = (p.join(F.broadcast(coded), "_label") if label else p.withColumn("code", F.lit(0))).drop("_label")
    sizes = p.groupBy(*by).agg(F.count("*").alias("size"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    sizes = cut(sizes.withColumn("cells", F.ceil(F.sqrt(F.col("size") / block))))
    placed = p.join(sizes, list(by)) if by else p.join(F.broadcast(sizes))
    cell = lambda c: F.least(F.col("cells") - 1, F.floor((F.col(c) - F.col(f"{c}0")) / F.greatest(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(1e-300)) * F.col("cells")))
    placed = placed.select(*by, "obs_id", "x", "y", "code", cell("x").alias("cx"), cell("y").alias("cy"))
    crowd = placed.groupBy(*by, "cx", "cy").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = placed.join(crowd, [*by, "cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("obs_id"), F.col("parts")))
    packed = placed.groupBy(*by, "cx", "cy", "part").agg(F.collect_list(F.struct("x", "y", "code")).alias("p"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    packed = cut(packed.withColumn("block", F.monotonically_increasing_id()))
    left = packed.select(*by, F.col("block").alias("a"), *[F.col(c).alias(f"a{c}") for c in ("x0", "x1", "y0", "y1")])
    right = packed.select(*by, F.col("block").alias("b"), *[F.col(c).alias(f"b{c}") for c in ("x0", "x1", "y0", "y1")])
    away = [F.greatest(F.lit(0.0), F.col(f"a{c}0") - F.col(f"b{c}1"), F.col(f"b{c}0") - F.col(f"a{c}1")) for c in ("x", "y")]
    meet = (left.join(right, list(by)) if by else left.join(right)).where("a <= b").where(away[0] * away[0] + away[1] * away[1] <= top * top * (1 + _SLACK)).select(*by, "a", "b")
    ways = meet.join(packed.select(F.col("block").alias("a"), F.col("p").alias("pa")), "a").join(packed.select(F.col("block").alias("b"), F.col("p").alias("pb")), "b")
    labels = len(names)

    def run(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                a, b = (tuple(np.array([p[c] for p in r[s]], t) for c, t in (("x", float), ("y", float), ("code", np.int64))) for s in ("pa", "pb"))
                got = histogram(a, b, labels, top, bins, upper)
                if r["a"] == r["b"]:
                    got[:, :, 1] -= np.diag(np.bincount(a[2], minlength=labels))
                else:
                    got = got + got.transpose(1, 0, 2)
                i, j, k = np.nonzero(got)
                yield pd.DataFrame({**{c: [r[c]] * len(i) for c in by}, "i": i.astype(np.int32), "j": j.astype(np.int32), "bin": k.astype(np.int32), "n": got[i, j, k]})

    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "i int, j int, bin int, n long"])
    counts = ways.repartition(ways.sparkSession.sparkContext.defaultParallelism * 4, "a", "b").mapInPandas(run, schema).groupBy(*by, "i", "j", "bin").agg(F.sum("n").alias("n"))
    if not label:
        return counts.select(*by, "bin", "n")
    a, b = (coded.select(F.col("_label").alias(f"label_{x}"), F.col("code").alias(c)) for x, c in (("a", "i"), ("b", "j")))
    return counts.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select(*by, "label_a", "label_b", "bin", "n")
