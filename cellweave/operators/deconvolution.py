"""Cell-type proportions of spots from reference profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.errors import DependencyError, IncompatibleDataError
from cellweave.storage import cut


def reference_profiles(reference: DataFrame, types: DataFrame) -> DataFrame:
    """(cell_type, gene_id, value): mean counts per type, zeros included."""
    n = types.groupBy("cell_type").agg(F.count("*").alias("n"))
    x = reference.join(types.select("obs_id", "cell_type"), "obs_id").groupBy("cell_type", "gene_id").agg(F.sum("value").alias("s"))
    return x.join(F.broadcast(n), "cell_type").select("cell_type", "gene_id", (F.col("s") / F.col("n")).alias("value"))


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by coordinate descent on the normal equations; rows of ``y`` are solved side by side."""
    return normal_nnls(a.T @ a, y @ a, rounds)


def normal_nnls(g: np.ndarray, h: np.ndarray, rounds: int = 300) -> np.ndarray:
    """``nnls`` from the products of the profiles with each other and with each row."""
    x = np.zeros(h.shape)
    d = np.maximum(np.diag(g), 1e-12)
    for _ in range(rounds):
        before = x.copy()
        for k in range(len(g)):
            x[:, k] = np.maximum(0, x[:, k] + (h[:, k] - x @ g[:, k]) / d[k])
        if np.abs(x - before).max() < 1e-10:
            break
    return x


def proportions(counts: DataFrame, profiles: DataFrame, least_genes: int = 100) -> DataFrame:
    """(obs_id, cell_type, proportion): NNLS of each spot on the profiles, rows summing to one (0 where nothing fits).

    A spot is known by its products with the profiles, one number a type, which a join and a sum give; the driver gets the
    products of types by types. Spots are solved in Arrow batches.
    """
    shared = profiles.select("gene_id").distinct().join(counts.select("gene_id").distinct(), "gene_id", "left_semi")
    table = cut(profiles.join(shared, "gene_id", "left_semi").where("cell_type is not null"))
    types = [r["cell_type"] for r in table.select("cell_type").distinct().orderBy("cell_type").collect()]
    if table.select("gene_id").distinct().count() < least_genes or len(types) < 2:
        raise IncompatibleDataError(f"at least {least_genes} shared genes and two types are needed")
    by_gene = cut(_by_gene(table, types))
    gram = _gram(by_gene, len(types))
    spots = _products(counts, by_gene, len(types))
    names = [str(t) for t in types]

    def run(it):
        for b in it:
            p = normal_nnls(gram, np.stack(b["h"].to_numpy())) if len(b) else np.zeros((0, len(names)))
            p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
            yield pd.DataFrame({"obs_id": np.repeat(b["obs_id"].to_numpy(), len(names)), "cell_type": names * len(b), "proportion": p.ravel()})

    return spots.mapInPandas(run, f"obs_id {dict(counts.dtypes)['obs_id']}, cell_type string, proportion double")


def _by_gene(table: DataFrame, types: list) -> DataFrame:
    """One row a gene, with the gene's value in each type (a0, a1, ...)."""
    return table.groupBy("gene_id").agg(*[F.sum(F.when(F.col("cell_type") == t, F.col("value")).otherwise(0.0)).alias(f"a{k}") for k, t in enumerate(types)])


def _gram(by_gene: DataFrame, many: int) -> np.ndarray:
    """Products of types by types: all that comes to the driver."""
    flat = by_gene.agg(*[F.sum(F.col(f"a{i}") * F.col(f"a{j}")) for i in range(many) for j in range(many)]).first()
    return np.array(flat, dtype=float).reshape(many, many)


def _products(counts: DataFrame, by_gene: DataFrame, many: int) -> DataFrame:
    """(obs_id, h): products of each spot's counts with the types."""
    return counts.join(by_gene, "gene_id").groupBy("obs_id").agg(F.array(*[F.sum(F.col("value") * F.col(f"a{k}")) for k in range(many)]).alias("h"))


#: Rounds of ``smooth_abundances`` at most, and the change, as a share of the largest abundance, at which it ends.
ROUNDS, SETTLED = 500, 1e-7


def _solved(gram: np.ndarray, extra: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Rows x >= 0 of least x (gram + extra_i I) x / 2 - x y_i, by coordinate descent from ``start``."""
    x = start.copy()
    d = np.maximum(np.diag(gram)[None, :] + extra[:, None], 1e-300)
    scale = max(np.abs(x).max(initial=0.0), 1e-300)
    for _ in range(rounds):
        most = 0.0
        for k in range(x.shape[1]):
            new = np.maximum(0.0, x[:, k] + (y[:, k] - x @ gram[:, k] - extra * x[:, k]) / d[:, k])
            most = max(most, np.abs(new - x[:, k]).max(initial=0.0))
            x[:, k] = new
        if most <= 1e-11 * max(scale, np.abs(x).max(initial=0.0)):
            break
    return x


def smooth_abundances(counts: DataFrame, profiles: DataFrame, edges: DataFrame, penalty: float, least_genes: int = 100, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(obs_id, b): non-negative abundances b (an array, types in order of name) of least

    sum over spots of |y - A b|^2 / 2 + penalty / 2 * sum over neighbours i, j of |b_i - b_j|^2,

    where A holds the profiles (cell_type, gene_id, value) and edges (src, dst) are undirected: either way round, repeated or
    not, they count once, and loops or spots without counts not at all. A spot is known by its products with the profiles, one
    number a type, so genes are summed away before the first round. A round bounds the penalty from above by terms of single
    spots around an extrapolated point: spots then solve small problems of their own, and need their neighbours' sum, one join
    and one sum over the edges. The extrapolation starts anew where it points uphill. Penalty 0 is plain NNLS. RuntimeError
    where it does not settle.
    """
    if penalty < 0:
        raise IncompatibleDataError("the penalty is at least 0")
    shared = profiles.select("gene_id").distinct().join(counts.select("gene_id").distinct(), "gene_id", "left_semi")
    table = profiles.join(shared, "gene_id", "left_semi").where("cell_type is not null")
    size = table.agg(F.countDistinct("gene_id").alias("g"), F.countDistinct("cell_type").alias("t")).first()
    if size["g"] < least_genes or size["t"] < 2:
        raise IncompatibleDataError(f"at least {least_genes} shared genes and two types are needed")
    types = [r["cell_type"] for r in table.select("cell_type").distinct().orderBy("cell_type").collect()]
    many, kind = len(types), dict(counts.dtypes)["obs_id"]
    by_gene = _by_gene(table, types)
    gram = _gram(by_gene, many)
    spots = _products(counts, by_gene, many)
    spots = cut(counts.select("obs_id").where("obs_id is not null").distinct().join(spots, "obs_id", "left").withColumn("h", F.coalesce("h", F.array(*[F.lit(0.0)] * many))))
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    pairs = pairs.join(spots.select(F.col("obs_id").alias("src")), "src", "left_semi").join(spots.select(F.col("obs_id").alias("dst")), "dst", "left_semi")
    near = cut(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    degree = near.groupBy(F.col("src").alias("obs_id")).agg(F.count("*").alias("degree"))
    schema = f"obs_id {kind}, h array<double>, degree double, b array<double>, c array<double>, moved double, uphill double"

    def solve(step: float):
        """Rows after a round: b is new, c lies ahead of it by ``step`` of its way."""

        def run(it):
            for x in it:
                if not len(x):
                    continue
                h, b, c, around = (np.stack(x[n].to_numpy()) for n in ("h", "b", "c", "around"))
                d = penalty * x["degree"].to_numpy()
                new = _solved(gram, 2 * d, h + d[:, None] * c + penalty * around, b)
                m = gram[None] + 2 * d[:, None, None] * np.eye(many)
                uphill = np.einsum("ij,ijk,ik->i", c - new, m, new - b)
                yield pd.DataFrame({"obs_id": x["obs_id"], "h": list(h), "degree": x["degree"], "b": list(new), "c": list(new + step * (new - b)), "moved": np.abs(new - b).max(axis=1), "uphill": uphill})

        return run

    nothing = F.array(*[F.lit(0.0)] * many)
    first = spots.join(degree, "obs_id", "left").select("obs_id", "h", F.coalesce(F.col("degree"), F.lit(0)).cast("double").alias("degree"), nothing.alias("b"), nothing.alias("c"), nothing.alias("around"))
    state, momentum = cut(first.mapInPandas(solve(0.0), schema)), 1.0
    if penalty == 0:
        return state.select("obs_id", "b")
    for _ in range(rounds):
        ahead = state.select(F.col("obs_id").alias("dst"), *[F.col("c")[k].alias(f"c{k}") for k in range(many)])
        around = near.join(ahead, "dst").groupBy(F.col("src").alias("obs_id")).agg(F.array(*[F.sum(f"c{k}") for k in range(many)]).alias("around"))
        grown = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        rows = state.select("obs_id", "h", "degree", "b", "c").join(around, "obs_id", "left").withColumn("around", F.coalesce("around", nothing))
        state = cut(rows.mapInPandas(solve((momentum - 1) / grown), schema))
        seen = state.agg(F.max("moved").alias("moved"), F.max(F.array_max("b")).alias("most"), F.sum("uphill").alias("uphill")).first()
        if seen["moved"] is None or seen["moved"] <= settled * max(seen["most"], 1e-300):
            return state.select("obs_id", "b")
        momentum = grown
        if seen["uphill"] > 0:
            momentum, state = 1.0, state.withColumn("c", F.col("b"))
    raise RuntimeError(f"abundances did not settle in {rounds} rounds")


def smooth_proportions(counts: DataFrame, profiles: DataFrame, edges: DataFrame, penalty: float, least_genes: int = 100, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(obs_id, cell_type, proportion): ``smooth_abundances`` with rows summing to one (0 where nothing fits)."""
    found = smooth_abundances(counts, profiles, edges, penalty, least_genes, rounds, settled)
    shared = profiles.join(counts.select("gene_id").distinct(), "gene_id", "left_semi").where("cell_type is not null")
    types = F.array(*[F.lit(r["cell_type"]) for r in shared.select("cell_type").distinct().orderBy("cell_type").collect()])
    total = F.aggregate("b", F.lit(0.0), lambda a, x: a + x)
    return found.select("obs_id", F.explode(F.arrays_zip(types.alias("cell_type"), F.col("b"))).alias("e"), total.alias("t")).select(
        "obs_id", F.col("e.cell_type").alias("cell_type"), F.when(F.col("t") > 0, F.col("e.b") / F.col("t")).otherwise(0.0).alias("proportion")
    )


def dominant(props: DataFrame, mixed_below: float | None = None) -> DataFrame:
    """(obs_id, cell_type, proportion): the largest, ties to the first name; Mixed below a share."""
    best = props.groupBy("obs_id").agg(F.max("proportion").alias("proportion"), F.min_by("cell_type", F.struct((-F.col("proportion")).alias("a"), F.col("cell_type").alias("b"))).alias("cell_type"))
    name = F.col("cell_type") if mixed_below is None else F.when(F.col("proportion") < mixed_below, "Mixed").otherwise(F.col("cell_type"))
    return best.select("obs_id", name.alias("cell_type"), "proportion")


def diversity(props: DataFrame) -> DataFrame:
    """(obs_id, entropy): Shannon entropy in bits over renormalised shares (1e-10 added), over log2 of the number of types."""
    p = props.withColumn("e", F.col("proportion") + 1e-10)
    t = p.groupBy("obs_id").agg(F.sum("e").alias("t"), F.count("*").alias("k"))
    q = p.join(t, "obs_id").withColumn("q", F.col("e") / F.col("t"))
    return q.groupBy("obs_id", "k").agg((-F.sum(F.col("q") * F.log2("q"))).alias("h")).select("obs_id", F.when(F.col("k") > 1, F.col("h") / F.log2("k")).otherwise(0.0).alias("entropy"))


def summary(props: DataFrame) -> DataFrame:
    """(cell_type, mean, n_dominant)."""
    d = dominant(props).groupBy("cell_type").agg(F.count("*").alias("n_dominant"))
    return props.groupBy("cell_type").agg(F.avg("proportion").alias("mean")).join(d, "cell_type", "left").na.fill(0, ["n_dominant"])


def normalised_mapping(mapping: DataFrame, types: DataFrame) -> DataFrame:
    """(obs_id, cell_type, proportion) from a cell-to-spot mapping (cell, obs_id, w): sums by type, rows to one."""
    s = mapping.join(types.select(F.col("obs_id").alias("cell"), "cell_type"), "cell").groupBy("obs_id", "cell_type").agg(F.sum("w").alias("w"))
    t = s.groupBy("obs_id").agg(F.sum("w").alias("t"))
    return s.join(t, "obs_id").select("obs_id", "cell_type", (F.col("w") / F.when(F.col("t") == 0, 1.0).otherwise(F.col("t"))).alias("proportion"))


def _deep(name: str):
    def stub(*_, **__):
        raise DependencyError(f"{name} needs torch or R; the native methods are nnls and spatial")

    return stub


METHODS = {"nnls": proportions, "spatial": smooth_proportions} | {m: _deep(m) for m in ("flashdeconv", "cell2location", "destvi", "stereoscope", "tangram", "rctd", "spotlight", "card")}


def deconvolve(method: str, counts: DataFrame, profiles: DataFrame, **params) -> DataFrame:
    if method not in METHODS:
        raise IncompatibleDataError(f"unknown method {method}; known: {', '.join(sorted(METHODS))}")
    return METHODS[method](counts, profiles, **params)
