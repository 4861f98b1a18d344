"""Seeded non-negative factorisation, and proportions of spots by way of its factors."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.errors import IncompatibleDataError
from cellweave.functions import stats
from cellweave.operators.deconvolution import _solved, nnls, reference_profiles
from cellweave.storage import cut


class Factors(NamedTuple):
    """obs (obs_id, f), genes (gene_id, f), f an array of factors; the squared error after each round."""

    obs: DataFrame
    genes: DataFrame
    errors: list[float]


def _gram(side: DataFrame, many: int) -> np.ndarray:
    """Products of factors, summed over all rows: many x many numbers."""
    flat = side.agg(*[F.coalesce(F.sum(F.col("f")[i] * F.col("f")[j]), F.lit(0.0)) for i in range(many) for j in range(many)]).first()
    return np.array(flat, dtype=float).reshape(many, many)


def _half(counts: DataFrame, key: str, other: DataFrame, old: DataFrame, gram: np.ndarray) -> DataFrame:
    """(key, f, term): each row of ``old`` solved against the other side, from where it stood; term is its share of the error
    without its values' squares. A join and one partial sum; a row's solution needs its products and ``gram`` only."""
    many, name = len(gram), next(c for c in other.columns if c != "f")
    sums = F.array(*[F.sum(F.col("value") * F.col("f")[i]) for i in range(many)])
    y = counts.join(other.select(name, "f"), name).groupBy(key).agg(sums.alias("y"))
    rows = old.select(key, "f").join(y, key, "left").withColumn("y", F.coalesce("y", F.array(*[F.lit(0.0)] * many)))

    def run(it):
        for b in it:
            if len(b):
                start, want = (np.stack(b[n].to_numpy()) for n in ("f", "y"))
                new = _solved(gram, np.zeros(len(b)), want, start)
                yield pd.DataFrame({key: b[key], "f": list(new), "term": np.einsum("ij,jk,ik->i", new, gram, new) - 2 * (new * want).sum(axis=1)})

    return cut(rows.mapInPandas(run, f"{key} {dict(old.dtypes)[key]}, f array<double>, term double"))


def factorise(counts: DataFrame, start: DataFrame, rounds: int = 50, settled: float = 1e-5) -> Factors:
    """Non-negative factors of (obs_id, gene_id, value) from first gene factors ``start`` (gene_id, f), arrays of one length.

    Observations, then genes, are solved in turn by non-negative least squares, so the squared error never rises; it ends after
    ``rounds``, or once a round takes off no more than ``settled`` of the sum of squares. Genes outside ``start`` take no part.
    Neither side is collected or broadcast: a round moves each value once to either side.
    """
    x = counts.where("obs_id is not null and value <> 0 and abs(value) < double('inf')").join(start.select("gene_id"), "gene_id", "left_semi")
    x = cut(x.select("obs_id", "gene_id", F.col("value").cast("double").alias("value")))
    first = start.first()
    if first is None or x.isEmpty():
        raise IncompatibleDataError("nothing to factorise")
    many = len(first["f"])
    squares = x.agg(F.sum(F.col("value") * F.col("value"))).first()[0]
    genes, obs, errors = cut(start.select("gene_id", "f")), x.select("obs_id").distinct().withColumn("f", F.array(*[F.lit(0.0)] * many)), []
    for _ in range(rounds):
        obs = _half(x, "obs_id", genes, obs, _gram(genes, many))
        genes = _half(x, "gene_id", obs, genes, _gram(obs, many))
        errors.append(squares + genes.agg(F.sum("term")).first()[0])
        if len(errors) > 1 and errors[-2] - errors[-1] <= settled * squares:
            break
    return Factors(obs.select("obs_id", "f"), genes.select("gene_id", "f"), errors)


def factor_proportions(counts: DataFrame, reference: DataFrame, types: DataFrame, markers: DataFrame | None = None, least: float = 0.0, least_genes: int = 100, rounds: int = 50, settled: float = 1e-5) -> DataFrame:
    """(obs_id, cell_type, proportion) of spots: the reference's cells (types: obs_id, cell_type) are factorised, a factor a type.

    Factors start at the types' mean profiles, or at those of ``markers`` (cell_type, gene_id) only. Genes are divided by their
    standard deviation in the reference first. A spot's factors are solved for, then its weights over the types' mean factors;
    rows sum to one (0 where nothing fits), shares under ``least`` are taken out before that.
    """
    known = types.where("obs_id is not null and cell_type is not null").select("obs_id", "cell_type")
    cells = reference.where("gene_id is not null and value <> 0").join(known.select("obs_id"), "obs_id", "left_semi")
    spread = stats.zero_aware(cells, ("gene_id",), F.lit(known.count()), ddof=1).where("var > 0").select("gene_id", F.sqrt("var").alias("sd"))
    spread = cut(spread.join(counts.select("gene_id").distinct(), "gene_id", "left_semi"))
    names = [r["cell_type"] for r in known.select("cell_type").distinct().orderBy("cell_type").collect()]
    if spread.count() < least_genes or len(names) < 2:
        raise IncompatibleDataError(f"at least {least_genes} shared genes and two types are needed")
    scaled = lambda t: t.join(spread, "gene_id").select("obs_id", "gene_id", (F.col("value") / F.col("sd")).alias("value"))
    ref, many = cut(scaled(cells)), len(names)
    profiles = reference_profiles(ref, known)
    if markers is not None:
        profiles = profiles.join(markers.select("cell_type", "gene_id").distinct(), ["cell_type", "gene_id"], "left_semi")
    wide = profiles.groupBy("gene_id").agg(F.array(*[F.sum(F.when(F.col("cell_type") == t, F.col("value")).otherwise(0.0)) for t in names]).alias("f"))
    start = spread.select("gene_id").join(wide, "gene_id", "left").withColumn("f", F.coalesce("f", F.array(*[F.lit(0.0)] * many)))
    fit = factorise(ref, start, rounds, settled)
    middle = fit.obs.join(known, "obs_id").groupBy("cell_type").agg(*[F.avg(F.col("f")[i]).alias(f"f{i}") for i in range(many)]).orderBy("cell_type").collect()
    table = np.array([[r[f"f{i}"] for i in range(many)] for r in middle])
    shown = [r["cell_type"] for r in middle]
    spots = counts.where("obs_id is not null").select("obs_id").distinct().withColumn("f", F.array(*[F.lit(0.0)] * many))
    solved = _half(scaled(counts.where("value <> 0")), "obs_id", fit.genes, spots, _gram(fit.genes, many))

    def run(it):
        for b in it:
            if len(b):
                p = nnls(table.T, np.stack(b["f"].to_numpy()))
                p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
                p[p < least] = 0.0
                p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
                yield pd.DataFrame({"obs_id": np.repeat(b["obs_id"].to_numpy(), len(shown)), "cell_type": shown * len(b), "proportion": p.ravel()})

    return solved.select("obs_id", "f").mapInPandas(run, f"obs_id {dict(counts.dtypes)['obs_id']}, cell_type string, proportion double")
