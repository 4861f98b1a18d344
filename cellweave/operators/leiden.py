"""Communities by the Leiden method: local moves, refinement into well-connected parts, contraction, again.

A graph of any size is a table of edges. Each round of local moves joins the edges with the labels, sums the links of a
node to each community and takes the move of largest gain in modularity, for the half of the nodes that a hash of the
round colours. Where modularity does not rise, the round is taken back; then communities are coloured, and one move is
made for each source of one colour and each target of the other: those do not touch each other, so modularity rises.

Refinement starts from single nodes inside each community. A single node that is well connected to its community joins
the well-connected part that gains most, over an edge to a part that stays in this round, so parts stay connected. Parts become the nodes of the next level,
which starts from the communities. Once a level has few edges (counted), one task takes it to its end in the same way.
Last, a community whose nodes are not connected is split into its components, which raises modularity.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators import neighbors
from cellweave.storage import cut

IN_TASK = 200_000
ROUNDS = 1000
_EPS, _SETTLED = 1e-9, 1e-7


# --- in one task -------------------------------------------------------------------------------------------------


class _Graph:
    """Weights of a small graph; a node's weight with itself counts twice in its degree."""

    def __init__(self, edges) -> None:
        self.near: dict = {}
        self.loop: dict = {}
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                self.near.setdefault(x, {})
                if a != b:
                    self.near[x][y] = self.near[x].get(y, 0.0) + w
            if a == b:
                self.loop[a] = self.loop.get(a, 0.0) + w
        self.degree = {x: sum(n.values()) + 2 * self.loop.get(x, 0.0) for x, n in self.near.items()}
        self.total = sum(self.degree.values()) or 1.0

    def links(self, x, of: dict) -> dict:
        out: dict = {}
        for y, w in self.near[x].items():
            out[of[y]] = out.get(of[y], 0.0) + w
        return out

    def contracted(self, part: dict) -> _Graph:
        edges: dict = {}
        for x, n in self.near.items():
            edges[part[x], part[x]] = edges.get((part[x], part[x]), 0.0) + self.loop.get(x, 0.0)
            for y, w in n.items():
                key = (min(part[x], part[y]), max(part[x], part[y]))
                edges[key] = edges.get(key, 0.0) + w / 2
        return _Graph((a, b, w) for (a, b), w in sorted(edges.items()))


def _moved(g: _Graph, com: dict, gamma: float) -> dict:
    """Local moves until no node gains; a node whose neighbours moved is looked at again. A node may also leave for a community of its own."""
    com, size = dict(com), {}
    for x in g.near:
        size[com[x]] = size.get(com[x], 0.0) + g.degree[x]
    queue, waiting, fresh = deque(sorted(g.near)), set(g.near), 0
    while queue:
        x = queue.popleft()
        waiting.discard(x)
        links, own, k = g.links(x, com), com[x], g.degree[x]
        size[own] -= k
        gain = {c: w - gamma * k * size[c] / g.total for c, w in links.items()}
        gain.setdefault(own, -gamma * k * size[own] / g.total)
        best = min(gain, key=lambda c: (-round(gain[c], 12), c != own, str(c)))
        if gain[best] < -_EPS:
            fresh += 1
            best = ("alone", fresh)
        elif best != own and gain[best] <= gain[own] + _EPS:
            best = own
        size[best] = size.get(best, 0.0) + k
        if best != own:
            com[x] = best
            for y in g.near[x]:
                if com[y] != best and y not in waiting:
                    queue.append(y)
                    waiting.add(y)
    return com


def _refined(g: _Graph, com: dict, gamma: float) -> dict:
    """Connected, well-connected parts of the communities: node to the node its part is named after."""
    inside, size = {}, {}
    for x in g.near:
        size[com[x]] = size.get(com[x], 0.0) + g.degree[x]
        inside[x] = sum(w for y, w in g.near[x].items() if com[y] == com[x])
    part, members, out = {x: x for x in g.near}, {x: 1 for x in g.near}, dict(inside)
    weight = dict(g.degree)
    well = lambda p, c: out[p] >= gamma * weight[p] * (size[c] - weight[p]) / g.total - _EPS
    for x in sorted(g.near):
        c = com[x]
        if part[x] != x or members[x] != 1 or not well(x, c):
            continue
        links = {p: w for p, w in g.links(x, {y: part[y] if com[y] == c else None for y in g.near[x]}).items() if p is not None and p != x and well(p, c)}
        gain = {p: w - gamma * weight[x] * weight[p] / g.total for p, w in links.items()}
        best = min(gain, key=lambda p: (-round(gain[p], 12), str(p)), default=None)
        if best is not None and gain[best] > _EPS:
            part[x], members[x] = best, 0
            members[best] += 1
            out[best] += inside[x] - 2 * links[best]
            weight[best] += weight[x]
    return part


def in_memory(edges, gamma: float = 1.0, start: dict | None = None, rounds: int = 3) -> dict:
    """Node to community, of a graph that fits a task; ``start`` are the communities to begin with."""
    first = _Graph(edges)
    com = dict(start) if start else {x: x for x in first.near}
    for _ in range(rounds):
        g, at, of, level = first, {x: x for x in first.near}, com, None
        while True:
            level = _moved(g, of, gamma)
            part = _refined(g, level, gamma)
            if len(set(part.values())) == len(g.near):
                break
            of = {p: level[x] for x, p in part.items()}
            g, at = g.contracted(part), {x: part[p] for x, p in at.items()}
        new = {x: level[p] for x, p in at.items()}
        same = len(set(zip(new.values(), (com[x] for x in new), strict=True))) == len(set(new.values())) == len({com[x] for x in new})
        com = new
        if same:
            break
    return com


# --- as tables ---------------------------------------------------------------------------------------------------


def _table(df: DataFrame) -> DataFrame:
    """``df`` cut; tables of nodes and edges meet by merges in every round, never by copies that pass the driver."""
    return cut(df).hint("merge")


def _both(half: DataFrame) -> DataFrame:
    apart = half.where("a <> b")
    return apart.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(apart.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))


def _degrees(half: DataFrame) -> DataFrame:
    ends = half.select(F.col("a").alias("u"), "w").unionByName(half.select(F.col("b").alias("u"), "w"))
    return ends.groupBy("u").agg(F.sum("w").alias("k"))


def _colour(c: Column, turn: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2))


def _local_moves(both: DataFrame, degrees: DataFrame, labels: DataFrame, total: float, gamma: float) -> DataFrame:
    """(u, c): ``labels`` after moves that raise modularity, until what is left to gain is next to nothing."""
    before, last, gain = -float("inf"), None, F.col("l") - gamma * F.col("k") * F.col("size") / total
    for turn in range(ROUNDS):
        own = degrees.join(labels.hint("merge"), "u").withColumnRenamed("c", "own")
        sizes = own.groupBy("own").agg(F.sum("k").alias("size"))
        links = both.join(labels.select(F.col("u").alias("v"), "c").hint("merge"), "v").groupBy("u", "c").agg(F.sum("w").alias("l"))
        choice = own.join(links.hint("merge"), "u", "left").join(sizes.withColumnRenamed("own", "c").hint("merge"), "c", "left")
        here = F.col("c") == F.col("own")
        best = choice.groupBy("u", "k", "own").agg(F.coalesce(F.max(F.when(here, F.col("l"))), F.lit(0.0)).alias("inner"), F.min(F.when(~here, F.struct((-F.round(gain, 10)).alias("minus"), F.col("c").alias("to")))).alias("best"))
        stay = F.col("inner") - gamma * F.col("k") * (F.col("size") - F.col("k")) / total
        seen = _table(best.join(sizes.hint("merge"), "own").select("u", "own", "k", "inner", "size", F.col("best.to").alias("to"), F.coalesce(-F.col("best.minus") - stay, F.lit(0.0)).alias("gain")))
        q, left = seen.agg(F.sum("inner") - gamma / total * F.sum(F.col("k") * F.col("size")), F.sum(F.greatest("gain", F.lit(0.0)))).first()
        if q <= before:  # the moves of the round before spoilt each other: of them, those that do not touch each other
            apart = last.where((F.col("gain") > _EPS) & (_colour(F.col("own"), turn) == 0) & (_colour(F.col("to"), turn) == 1))
            one = apart.groupBy("own").agg(F.max_by(F.struct("u", "to", "gain"), F.struct("gain", "u")).alias("m")).select("m.*")
            one = one.groupBy("to").agg(F.max_by("u", F.struct("gain", "u")).alias("u"))
            labels = _table(last.select("u", "own").join(one.hint("merge"), "u", "left").select("u", F.coalesce("to", "own").alias("c")))
            before -= _EPS
            continue
        if left <= _SETTLED * total:
            return seen.select("u", F.col("own").alias("c"))
        before, last = q, seen
        moves = (F.col("gain") > _EPS) & (_colour(F.col("u"), turn) == 0)
        labels = seen.select("u", F.when(moves, F.col("to")).otherwise(F.col("own")).alias("c"))
    raise RuntimeError(f"local moves did not settle in {ROUNDS} rounds")


def _refinement(both: DataFrame, degrees: DataFrame, labels: DataFrame, total: float, gamma: float) -> DataFrame:
    """(u, p): connected parts of the communities, named after one of their nodes."""
    ends = both.join(labels.hint("merge"), "u").join(labels.select(F.col("u").alias("v"), F.col("c").alias("d")).hint("merge"), "v")
    inner = _table(ends.where(F.col("c") == F.col("d")).select("u", "v", "w"))
    whole = degrees.join(labels.hint("merge"), "u").groupBy("c").agg(F.sum("k").alias("whole"))
    nodes = _table(degrees.join(labels.hint("merge"), "u").join(whole.hint("merge"), "c").select("u", "k", "whole"))
    parts = nodes.select("u", F.col("u").alias("p"))
    for turn in range(ROUNDS):
        links = inner.join(parts.select(F.col("u").alias("v"), F.col("p").alias("to")).hint("merge"), "v").groupBy("u", "to").agg(F.sum("w").alias("l"))
        links = links.join(nodes.join(parts.hint("merge"), "u").hint("merge"), "u")
        out = links.groupBy("p").agg(F.sum(F.when(F.col("to") != F.col("p"), F.col("l"))).alias("out"))
        sizes = nodes.join(parts.hint("merge"), "u").groupBy("p").agg(F.sum("k").alias("weight"), F.count("*").alias("members"), F.first("whole").alias("whole"))
        sizes = sizes.join(out.hint("merge"), "p").where(F.coalesce("out", F.lit(0.0)) >= gamma * F.col("weight") * (F.col("whole") - F.col("weight")) / total - _EPS)
        sizes = sizes.select("p", "weight", "members")
        singles = links.join(sizes.where("members = 1").select("p").hint("merge"), "p", "left_semi")
        gain = F.col("l") - gamma * F.col("k") * F.col("weight") / total
        options = singles.where("to <> p").join(sizes.select(F.col("p").alias("to"), "weight").hint("merge"), "to").withColumn("gain", gain).where(F.col("gain") > _EPS)
        options = _table(options.select("u", "p", "to", "gain"))
        if options.isEmpty():
            return parts
        leaves = options.where(_colour(F.col("p"), turn) == 0)
        staying = leaves.join(leaves.select(F.col("p").alias("to")).distinct().hint("merge"), "to", "left_anti")
        best = staying.groupBy("u").agg(F.min(F.struct((-F.round("gain", 10)).alias("minus"), F.col("to").alias("to"))).alias("best"))
        parts = _table(parts.join(best.select("u", F.col("best.to").alias("to")).hint("merge"), "u", "left").select("u", F.coalesce("to", "p").alias("p")))
    raise RuntimeError(f"refinement did not settle in {ROUNDS} rounds")


def leiden(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, in_task: int = IN_TASK) -> DataFrame:
    """(obs_id, cluster) of every one of ``nodes`` (obs_id): communities of the undirected graph of ``edges`` (src, dst[, w]).

    Weights of an edge named several times, either way round, are added; loops count. Clusters are numbered by size, ties
    to the smallest id; nodes without an edge are -1. Levels of up to ``in_task`` edges are finished in one task.
    """
    kind = dict(edges.dtypes)["src"]
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    half = _table(edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w")).where("w > 0"))
    first, flat, labels = half, None, None
    total = half.agg(2 * F.sum("w")).first()[0]
    if not total:
        return nodes.select("obs_id", F.lit(-1).cast("long").alias("cluster"))
    while True:
        degrees = _table(_degrees(half))
        labels = degrees.select("u", F.col("u").alias("c")) if labels is None else labels
        if half.count() <= in_task:
            found = _finished(half.join(labels.select(F.col("u").alias("a"), F.col("c").alias("of_a")).hint("merge"), "a").join(labels.select(F.col("u").alias("b"), F.col("c").alias("of_b")).hint("merge"), "b"), resolution, kind)
            break
        both = _both(half)
        labels = _table(_local_moves(both, degrees, labels, total, resolution))
        parts = _refinement(both, degrees, labels, total, resolution)
        found = labels
        if parts.select("p").distinct().count() == parts.count():
            break
        flat = _table(parts.select(F.col("u").alias("obs_id"), "p") if flat is None else flat.withColumnRenamed("p", "u").join(parts, "u").select("obs_id", "p"))
        a, b = (parts.select(F.col("u").alias(x), F.col("p").alias(y)) for x, y in (("a", "pa"), ("b", "pb")))
        half = _table(half.join(a, "a").join(b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w")))
        labels = _table(parts.join(labels, "u").select(F.col("p").alias("u"), "c").distinct())
    com = _table(found.select(F.col("u").alias("obs_id"), "c") if flat is None else flat.join(found.withColumnRenamed("u", "p"), "p").select("obs_id", "c"))
    return _numbered(_connected(first, com), nodes)


def _finished(half: DataFrame, gamma: float, kind: str) -> DataFrame:
    """(u, c) of a level of few edges, with the communities it starts from, in one task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        start = dict(zip(g["a"], g["of_a"], strict=True)) | dict(zip(g["b"], g["of_b"], strict=True))
        com = in_memory(sorted(zip(g["a"].tolist(), g["b"].tolist(), g["w"].tolist(), strict=True)), gamma, start)
        least: dict = {}
        for x in sorted(com):
            least.setdefault(com[x], x)
        return pd.DataFrame({"u": list(com), "c": [least[c] for c in com.values()]})

    return half.select("a", "b", "w", "of_a", "of_b", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, f"u {kind}, c {kind}")


def _connected(half: DataFrame, com: DataFrame) -> DataFrame:
    """(obs_id, c): communities split into their connected components."""
    a, b = (com.select(F.col("obs_id").alias(x), F.col("c").alias(y)) for x, y in (("a", "ca"), ("b", "cb")))
    inner = half.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("ca = cb and a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return neighbors.connected(inner, com.select("obs_id")).select("obs_id", F.col("component").alias("c"))


def _numbered(com: DataFrame, nodes: DataFrame) -> DataFrame:
    """Communities by size; the place of one is the number of those in front of it, found by ranges and their counts."""
    sizes = _table(com.groupBy("c").agg((-F.count("*")).alias("minus")))
    ranged = _table(sizes.repartitionByRange("minus", "c").sortWithinPartitions("minus", "c").select("c", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    starts, at = [], 0
    for part, n, low in sorted(map(tuple, ranged.groupBy("part").agg(F.count("*"), F.min("at")).collect())):  # a row for each partition
        starts.append((part, at - low))
        at += n
    shift = com.sparkSession.createDataFrame(starts, "part int, shift long")
    number = ranged.join(F.broadcast(shift), "part").select("c", (F.col("at") + F.col("shift")).alias("cluster"))
    return nodes.select("obs_id").join(com.join(number.hint("merge"), "c").select("obs_id", "cluster").hint("merge"), "obs_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long")))


def modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity): one row; edges as in ``leiden``, clusters (obs_id, cluster)."""
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    of = lambda end, name: clusters.select(F.col("obs_id").alias(end), F.col("cluster").alias(name))
    both = e.join(of("src", "c"), "src").join(of("dst", "d"), "dst")
    per = both.select("c", F.when(F.col("c") == F.col("d"), F.col("w")).otherwise(0.0).alias("inner"), "w").unionByName(both.select(F.col("d").alias("c"), F.lit(0.0).alias("inner"), "w"))
    per = per.groupBy("c").agg(F.sum("inner").alias("inner"), F.sum("w").alias("k"))
    return per.agg((2 * F.sum("inner") / F.sum("k") - resolution * F.sum(F.col("k") * F.col("k")) / (F.sum("k") * F.sum("k"))).alias("modularity"))
