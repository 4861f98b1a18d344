"""Cell types from a binary marker table: a mixture of negative binomials, fitted by expectation-maximisation.

A gene's rate is one base rate in the types that it does not mark, and in each type that it marks a rate of its own, at least
``RAISE`` times the base; cells differ by their size factors. A count is taken as Poisson with a gamma factor of mean one, whose
spread is the gene's dispersion; with the type and that factor as what is missing, rates have a closed form, so the likelihood
never falls. A round is one narrow pass over the cells: partitions send their sums over types and genes, no cell moves.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.errors import DataError
from cellweave.operators.annotation import marker_size_factors
from cellweave.storage import cut

RAISE, LEAST_RATE = 2.0, 1e-9
#: Types times marker genes: what travels with a task. More is refused.
MOST_MARKERS = 4_000_000


class Fit(NamedTuple):
    types: list[str]
    genes: list
    rates: np.ndarray  # types x genes
    weights: np.ndarray  # of the types
    shape: np.ndarray  # of the genes: one over the dispersion
    likelihoods: list[float]  # before each round, without the terms that only counts and shapes make


def _posterior(y: np.ndarray, size: np.ndarray, rates: np.ndarray, weights: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each cell's share of each type, its log-likelihood) of counts (cells x genes)."""
    joint = np.empty((len(y), len(weights)))
    for k, rate in enumerate(rates):
        mu = size[:, None] * rate
        joint[:, k] = np.log(weights[k]) + (y * np.log(mu) - (y + shape) * np.log(mu + shape) + shape * np.log(shape)).sum(axis=1)
    top = joint.max(axis=1, keepdims=True)
    share = np.exp(joint - top)
    total = share.sum(axis=1, keepdims=True)
    return share / total, (top + np.log(total))[:, 0]


def _raised(y: np.ndarray, s: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The rates (types x genes) that best explain weighted counts ``y`` over exposures ``s``, marked ones at least RAISE times the base."""
    rates = np.empty_like(y)
    for g in range(y.shape[1]):
        at = np.flatnonzero(marks[:, g])
        own = y[at, g] / np.maximum(s[at, g], 1e-300)
        top, below = y[~marks[:, g], g].sum(), s[~marks[:, g], g].sum()
        tied = np.zeros(len(at), dtype=bool)
        for i in np.argsort(own, kind="stable"):  # those under the bound are tied to the base, the lowest first
            if below > 0 and own[i] >= RAISE * top / below:
                break
            tied[i] = True
            top, below = top + y[at[i], g], below + RAISE * s[at[i], g]
        base = max(top / max(below, 1e-300), LEAST_RATE)
        rates[:, g] = base
        rates[at, g] = np.where(tied, RAISE * base, np.maximum(own, RAISE * base))
    return rates


def _vectors(counts: DataFrame, markers: DataFrame) -> tuple[DataFrame, list, list, np.ndarray]:
    """(cells as (obs_id, size, y: counts of marker genes), types, genes, marks). Cells without any count take no part."""
    present = counts.select("gene_id").distinct()
    pairs = markers.where("direction > 0").select("cell_type", "gene_id").where("cell_type is not null and gene_id is not null").distinct().join(present, "gene_id", "left_semi")
    size = pairs.agg(F.countDistinct("cell_type").alias("t"), F.countDistinct("gene_id").alias("g")).first()
    if not size["t"] or size["t"] * size["g"] > MOST_MARKERS:
        raise DataError(f"{size['t']} types by {size['g']} marker genes; at least one type with a marker among the genes and at most {MOST_MARKERS} in all")
    rows = pairs.collect()  # bounded just now
    types, genes = sorted({r["cell_type"] for r in rows}), sorted({r["gene_id"] for r in rows})
    marks = np.zeros((len(types), len(genes)), dtype=bool)
    for r in rows:
        marks[types.index(r["cell_type"]), genes.index(r["gene_id"])] = True
    place = {g: i for i, g in enumerate(genes)}
    x = counts.join(F.broadcast(pairs.select("gene_id").distinct()), "gene_id", "left_semi").where("value > 0")
    lists = x.groupBy("obs_id").agg(F.collect_list("gene_id").alias("g"), F.collect_list("value").alias("v"))  # at most the marker genes
    sized = marker_size_factors(counts.where("value is not null")).where("size_factor > 0").join(lists, "obs_id", "left")

    def dense(it):
        for b in it:
            y = np.zeros((len(b), len(genes)))
            for i, (g, v) in enumerate(zip(b["g"], b["v"], strict=True)):
                if g is not None:
                    y[i, [place[k] for k in g]] = v
            yield pd.DataFrame({"obs_id": b["obs_id"], "size": b["size_factor"], "y": list(y)})

    return cut(sized.mapInPandas(dense, f"obs_id {dict(counts.dtypes)['obs_id']}, size double, y array<double>")), types, genes, marks


def _summed(cells: DataFrame, part, length: int) -> np.ndarray:
    """The sum over all cells of ``part(y, size)``, an array of ``length`` numbers; eight tasks add up the partitions' sums."""

    def run(it):
        total = np.zeros(length)
        for b in it:
            if len(b):
                total += part(np.stack(b["y"].to_numpy()), b["size"].to_numpy())
        yield pd.DataFrame({"m": [total.tobytes()]})

    def added(it):
        total = np.zeros(length)
        for b in it:
            for m in b["m"]:
                total += np.frombuffer(m)
        yield pd.DataFrame({"m": [total.tobytes()]})

    parts = cells.select("y", "size").mapInPandas(run, "m binary").repartition(8).mapInPandas(added, "m binary")
    return np.sum([np.frombuffer(r["m"]) for r in parts.collect()], axis=0)


def _fit(cells: DataFrame, types: list, genes: list, marks: np.ndarray, rounds: int, tolerance: float) -> Fit:
    n_types, n_genes = marks.shape

    def moments(y, size):
        x = y / size[:, None]
        return np.concatenate([[len(y)], x.sum(axis=0), (x * x).sum(axis=0), (1 / size).sum(keepdims=True)])

    m = _summed(cells, moments, 2 + 2 * n_genes)
    n = max(m[0], 1.0)
    mean = m[1 : 1 + n_genes] / n
    spread = m[1 + n_genes : -1] / n - mean**2 - mean * m[-1] / n
    # Half of what is beyond Poisson: the rest is taken to lie between types.
    shape = 1 / np.clip(0.5 * spread / np.maximum(mean, 1e-12) ** 2, 0.01, 10.0)
    rates = np.maximum(mean, LEAST_RATE) * np.where(marks, RAISE + 1.0, 1.0)
    weights = np.full(n_types, 1 / n_types)
    length, trace = 2 * n_types * n_genes + n_types + 1, []
    for _ in range(rounds):

        def part(y, size, rates=rates, weights=weights):
            share, likelihood = _posterior(y, size, rates, weights, shape)
            s = np.empty((n_types, n_genes))
            for k in range(n_types):
                mu = size[:, None] * rates[k]
                s[k] = (share[:, k] * size) @ ((y + shape) / (mu + shape))
            return np.concatenate([(share.T @ y).ravel(), s.ravel(), share.sum(axis=0), [likelihood.sum()]])

        total = _summed(cells, part, length)
        trace.append(float(total[-1]))
        if len(trace) > 1 and trace[-1] - trace[-2] <= tolerance * n:
            break
        y, s = total[: n_types * n_genes].reshape(n_types, n_genes), total[n_types * n_genes : 2 * n_types * n_genes].reshape(n_types, n_genes)
        rates = _raised(y, s, marks)
        weights = np.maximum(total[-1 - n_types : -1] / n, 1e-12)
        weights /= weights.sum()
    return Fit(types, genes, rates, weights, shape, trace)


def assign(counts: DataFrame, markers: DataFrame, rounds: int = 200, tolerance: float = 1e-3) -> DataFrame:
    """(obs_id, cell_type, confidence): the type of the largest posterior share (ties: the first name), from raw counts and
    markers (cell_type, gene_id, direction; only direction 1 is used).

    Types without a marker among the genes are left out; DataError where none is left. Cells without a count have no row; a
    cell without a count of any marker goes by the zeros. Rounds end when the likelihood gains under ``tolerance`` a cell.
    """
    cells, types, genes, marks = _vectors(counts, markers)
    fit = _fit(cells, types, genes, marks, rounds, tolerance)

    def best(it):
        for b in it:
            if len(b):
                share, _ = _posterior(np.stack(b["y"].to_numpy()), b["size"].to_numpy(), fit.rates, fit.weights, fit.shape)
                at = share.argmax(axis=1)
                yield pd.DataFrame({"obs_id": b["obs_id"], "cell_type": [types[k] for k in at], "confidence": share[np.arange(len(b)), at]})

    return cells.mapInPandas(best, f"obs_id {dict(counts.dtypes)['obs_id']}, cell_type string, confidence double")


def fit(counts: DataFrame, markers: DataFrame, rounds: int = 200, tolerance: float = 1e-3) -> Fit:
    """The fitted mixture alone."""
    return _fit(*_vectors(counts, markers), rounds, tolerance)
