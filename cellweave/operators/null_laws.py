"""Ligand-receptor p-values without permutations: laws of group summaries where labels are dealt at random."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.errors import ParameterError
from cellweave.functions import stats
from cellweave.storage import cut

#: Bins of a gene's values for means and for quantiles, atoms of a law, lattice points of a transform, groups at most, and the
#: least p that is told apart from 0.
BINS, FINE, ATOMS, LATTICE, GROUPS, LEAST = 1024, 1 << 16, 1024, 1 << 17, 10_000, 1e-12

#: Summaries of a group by name: the mean, or the quantile of that share (the value at place ceil(share n)).
SUMMARIES = {"mean": None, "median": 0.5, "q3": 0.75, "q90": 0.9}
AGGREGATES = ("min", "average")
SCORES = ("arithmetic", "geometric")


def logged(expr: DataFrame, most: float = 14.0) -> DataFrame:
    """``expr``, or where a value is over ``most``, cells brought to totals of 10,000 and ln(1 + x)."""
    from cellweave.operators import preprocess

    top = expr.agg(F.max("value")).first()[0]
    return preprocess.normalise(expr, 1e4) if top is not None and top > most else expr


def _packed(v: np.ndarray, m: np.ndarray, atoms: int = ATOMS) -> tuple[np.ndarray, np.ndarray]:
    """A law as at most ``atoms`` values and masses: equal cells, each at the mean of what it holds."""
    keep = m > 1e-15
    v, m = v[keep], m[keep]
    if len(v) > atoms:
        lo, hi = v.min(), v.max()
        cell = np.minimum(((v - lo) / (hi - lo) * atoms).astype(int), atoms - 1)
        mass = np.bincount(cell, m, atoms)
        at = np.bincount(cell, m * v, atoms)
        v, m = at[mass > 0] / mass[mass > 0], mass[mass > 0]
    order = np.argsort(v, kind="stable")
    return v[order], m[order] / m.sum()


def mean_law(x: np.ndarray, c: np.ndarray, step: float, n: int, finite: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(values, masses) of the mean of n draws from values x with counts c.

    The characteristic function of one draw to the n-th power, transformed back over a window that Bernstein's bound leaves
    with 1e-15 outside. Values lie between multiples of ``step`` and are split between the two, which keeps the mean. Windows of
    more than 2^17 steps take the lowest frequencies only, from the values as they are: the others are nothing by then.
    ``finite``: draws without replacement have a smaller variance, so the law is drawn in towards its mean by that.
    """
    total = c.sum()
    p = c / total
    mu = p @ x
    var = p @ (x - mu) ** 2
    if var <= 0 or (finite and n >= total):
        return np.array([mu]), np.array([1.0])
    low = np.floor(x / step + 1e-9)
    share = np.maximum(0.0, x / step - low)
    first, last = low.min(), (low + (share > 0)).max()
    reach, bound = np.abs(x - mu).max(), np.log(1e15)
    away = bound * reach / 3 + np.sqrt((bound * reach / 3) ** 2 + 2 * bound * n * var)
    whole, window = n * (last - first) + 1, 2 * away / step + 2
    length = 1 << int(np.ceil(np.log2(max(2.0, min(whole, window)))))
    if length <= LATTICE:
        places = low.astype(np.int64)
        one = np.bincount(places % length, p * (1 - share), length) + np.bincount((places + 1) % length, p * share, length)
        mass = np.fft.irfft(np.fft.rfft(one) ** n, length)
        start = int(n * first) if whole <= length else int(np.floor(n * mu / step)) - length // 2
        at = start + np.arange(length)
        v, m = at * (step / n), mass[at % length]
    else:
        points = 4096
        width = length * step
        phi = np.concatenate([np.exp(1j * np.outer(t, x - mu)) @ p for t in np.array_split(2 * np.pi * np.arange(points // 2 + 1) / width, 16)])
        m = np.roll(np.fft.irfft(np.conj(phi**n), points), points // 2)
        v = mu + (np.arange(points) - points // 2) * (width / points / n)
    if finite:
        v = mu + (v - mu) * np.sqrt((total - n) / (total - 1))
    return _packed(v, np.maximum(m, 0.0))


def _log_factorial(k: np.ndarray) -> np.ndarray:
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 32)))])
    y = np.maximum(k, 16.0) + 1
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(k < 32, small[np.minimum(k, 31).astype(int)], series)


def _below(k: int, below: np.ndarray, total: int, n: int, finite: bool) -> np.ndarray:
    """P(at most k - 1 of n draws are among the first ``below`` of ``total``), for each of ``below``: summed on the side of k
    away from the mean, five roots of n far and 50 more. Terms fall there at least as exp(-2 t^2 / n), so what is beyond is under 1e-21 of the sum."""
    reach = min(n, 5 * int(np.ceil(np.sqrt(n))) + 50)
    below, f = np.asarray(below, float), _log_factorial
    out = np.empty(len(below))
    low = k - 1 < n * below / total
    for under in (True, False):
        j = np.arange(max(0, k - reach), k, dtype=float) if under else np.arange(k, min(n, k + reach) + 1, dtype=float)
        rows = np.flatnonzero(low == under)
        for some in np.array_split(rows, max(1, len(rows) * len(j) // 200_000)):
            b = below[some][:, None]
            if finite:
                fits = (j <= b) & (n - j <= total - b)
                left, right = np.maximum(b - j, 0.0), np.maximum(total - b - n + j, 0.0)
                one = f(np.array([total, n, total - n], float))
                t = f(b) - f(left) + f(total - b) - f(right) - (f(j) + f(n - j))[None, :] - (one[0] - one[1] - one[2])
            else:
                fits = ((b > 0) | (j == 0)) & ((b < total) | (j == n))
                odds = np.clip(b / total, 1e-300, 1 - 1e-16)
                t = f(np.array([float(n)])) - (f(j) + f(n - j))[None, :] + j * np.log(odds) + (n - j) * np.log1p(-odds)
            s = np.minimum(1.0, np.where(fits, np.exp(np.where(fits, t, 0.0)), 0.0).sum(axis=1))
            out[some] = s if under else 1.0 - s
    return out


def quantile_law(x: np.ndarray, c: np.ndarray, n: int, share: float, finite: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(values, masses) of the ceil(share n)-th smallest of n draws from rising values x with counts c.

    More than 1024 values become that many cells of rank, narrow where the law is: ten standard deviations around the share.
    """
    k, total, below = max(1, int(np.ceil(share * n - 1e-9))), c.sum(), np.cumsum(c) - c
    if len(x) > ATOMS:
        half = 10 * np.sqrt(share * (1 - share) / n) + 2 / n
        place = np.clip((below / total - share) / half, -1.0, 1.0)
        _, at, cell = np.unique(np.floor((place + 1) / 2 * (ATOMS - 1)), return_index=True, return_inverse=True)
        x, below = np.bincount(cell, c * x) / np.bincount(cell, c), below[at]
    above = np.append(_below(k, below, int(total), n, finite), 0.0)  # P(summary >= x)
    above[0] = 1.0
    return _packed(x, np.maximum(0.0, -np.diff(above)))


def lowest_law(laws: list) -> tuple[np.ndarray, np.ndarray]:
    """The law of the least of independent values."""
    v = np.unique(np.concatenate([a for a, _ in laws]))
    above = np.ones(len(v) + 1)
    above[-1] = 0.0
    for a, m in laws:
        tail = np.append(np.cumsum(m[::-1])[::-1], 0.0)
        above[:-1] *= np.minimum(1.0, tail[np.searchsorted(a, v, "left")])
    return _packed(v, np.maximum(0.0, -np.diff(above)))


def average_law(laws: list) -> tuple[np.ndarray, np.ndarray]:
    """The law of the average of independent values."""
    v, m = reduce(lambda one, two: _packed(np.add.outer(one[0], two[0]).ravel(), np.multiply.outer(one[1], two[1]).ravel()), laws)
    return v / len(laws), m


def upper(first: tuple, second: tuple, score: float, how: str) -> float:
    """P(score of two independent values >= ``score``), no less than 1e-12."""
    (v, m), (w, k) = first, second
    tail = np.append(np.cumsum(k[::-1])[::-1], 0.0)
    slack = 1e-9 * (abs(score) + 1e-3)
    if how == "arithmetic":
        p = m @ tail[np.searchsorted(w, 2 * score - slack - v, "left")]
    elif score <= slack:
        p = 1.0
    else:
        up = v > 0
        p = m[up] @ tail[np.searchsorted(w, (score - slack) ** 2 / v[up], "left")]
    return float(min(1.0, max(LEAST, p)))


def group_laws(expr: DataFrame, groups: DataFrame, summary: str = "mean", finite: bool = True) -> DataFrame:
    """(gene_id, group, observed, fraction, v, m): each group's summary of each gene with its law under random labels; see ``all_laws``."""
    return all_laws(expr, groups, (summary,), finite).drop("summary")


def all_laws(expr: DataFrame, groups: DataFrame, summaries: tuple[str, ...] = tuple(SUMMARIES), finite: bool = True) -> DataFrame:
    """(gene_id, group, summary, observed, fraction, v, m): several summaries from one count of the values.

    Values are counted in bins first, 1024 a gene for means and 65,536 for quantiles (whole numbers of a smaller range in bins of
    their own), so a gene's task holds groups x bins rows whatever the number of cells; a bin stands for the mean of its values. With
    quantiles, the bins of means are put together from theirs, of which 64 make one. Zeros have no rows and count.
    ``groups`` (obs_id, group) has a row per obs; rows without a group, an id or a finite value take no part, nor do genes
    without a value. More than 10,000 groups raise.
    """
    for summary in summaries:
        if summary not in SUMMARIES:
            raise ParameterError(f"unknown summary {summary}; known: {', '.join(SUMMARIES)}")
    types = dict(expr.dtypes)["gene_id"], dict(groups.dtypes)["group"]
    g = groups.where("obs_id is not null and group is not null").select("obs_id", "group")
    known = [(r["group"], r["n"]) for r in g.groupBy("group").agg(F.count("*").alias("n")).limit(GROUPS + 1).collect()]
    if len(known) > GROUPS:
        raise ParameterError(f"more than {GROUPS} groups")
    total = sum(n for _, n in known)
    many = BINS if all(SUMMARIES[x] is None for x in summaries) else FINE
    numbers = expr.sparkSession.createDataFrame([(name, i) for i, (name, _) in enumerate(known)], f"group {types[1]}, at int")
    g = g.join(F.broadcast(numbers), "group").select("obs_id", "at")
    x = expr.where("gene_id is not null and value <> 0 and abs(value) < double('inf')").select("obs_id", "gene_id", F.col("value").cast("double").alias("value"))
    x = cut(x.join(g, "obs_id").select("gene_id", "at", "value"))
    span = F.greatest(F.max("value"), F.lit(0.0)) - F.least(F.min("value"), F.lit(0.0))
    size = x.groupBy("gene_id").agg(span.alias("span"), F.max(F.abs(F.col("value") - F.round("value"))).alias("off"))
    step = lambda n: F.when((F.col("off") == 0) & (F.col("span") <= n), 1.0).otherwise(F.col("span") / n)
    size = cut(size.select("gene_id", step(many).alias("step"), step(BINS).alias("coarse")))
    bin_ = F.floor(F.col("value") / F.col("step")).cast("int").alias("bin")
    bins = x.join(size, "gene_id").groupBy("gene_id", "at", bin_).agg(F.count("*").cast("int").alias("n"), F.sum("value").alias("s"), F.count_if(F.col("value") > 0).cast("int").alias("k"))

    def pooled(place: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rising values and counts of bins, zeros among them."""
        _, at = np.unique(place, return_inverse=True)
        n, s = np.bincount(at, n), np.bincount(at, s)
        x, c = np.append(0.0, s / n), np.append(total - n.sum(), n)
        order = np.argsort(x, kind="stable")
        return x[order][c[order] > 0], c[order][c[order] > 0]

    def law(b: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        gene, fine, coarse = steps["gene_id"].iloc[0], float(steps["step"].iloc[0]), float(steps["coarse"].iloc[0])
        at, n, s, k = b["at"].to_numpy(), b["n"].to_numpy(), b["s"].to_numpy(), b["k"].to_numpy()
        places, inside = np.unique(b["bin"].to_numpy(), return_inverse=True)
        size, sums = np.bincount(inside, n), np.bincount(inside, s)
        value = sums / size
        by_group = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[by_group], np.arange(len(known) + 1))
        rows = []
        for summary in summaries:
            share, laws = SUMMARIES[summary], {}
            whole = pooled(np.floor(places / (coarse / fine)) if share is None else places, size, sums)
            for i, (group, of) in enumerate(known):
                if of not in laws:
                    laws[of] = mean_law(*whole, coarse, of, finite) if share is None else quantile_law(*whole, of, share, finite)
                mine = by_group[ends[i] : ends[i + 1]]
                if not len(mine):
                    observed = 0.0
                elif share is None:
                    observed = s[mine].sum() / of
                else:
                    seen, times = np.append(0.0, value[inside[mine]]), np.append(of - n[mine].sum(), n[mine])
                    order = np.argsort(seen, kind="stable")
                    observed = seen[order][np.searchsorted(np.cumsum(times[order]), max(1, np.ceil(share * of - 1e-9)), "left")]
                rows.append((gene, group, summary, float(observed), float(k[mine].sum() / of), *laws[of]))
        return pd.DataFrame(rows, columns=["gene_id", "group", "summary", "observed", "fraction", "v", "m"])

    schema = f"gene_id {types[0]}, group {types[1]}, summary string, observed double, fraction double, v array<double>, m array<double>"
    return bins.groupBy("gene_id").cogroup(size.groupBy("gene_id")).applyInPandas(law, schema)


def complex_laws(laws: DataFrame, members: DataFrame, how: str = "min") -> DataFrame:
    """Laws of complexes (complex, gene_id), as rows of ``group_laws`` with the complex for a gene: the least or the average of
    members taken as independent; a complex with a member that has no law is left out. Its fraction is the least one."""
    if how not in AGGREGATES:
        raise ParameterError(f"unknown aggregate {how}; known: {', '.join(AGGREGATES)}")
    m = members.where("complex is not null and gene_id is not null").select("complex", "gene_id").distinct()
    n = m.groupBy("complex").agg(F.count("*").alias("size"))
    x = laws.join(m, "gene_id").join(n, "complex")

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        if len(b) < b["size"].iloc[0]:
            return b.iloc[:0][["complex", "group", "observed", "fraction", "v", "m"]]
        parts = list(zip(b["v"], b["m"], strict=True))
        v, k = lowest_law(parts) if how == "min" else average_law(parts)
        seen = b["observed"].min() if how == "min" else b["observed"].mean()
        return pd.DataFrame([(b["complex"].iloc[0], b["group"].iloc[0], seen, b["fraction"].min(), v, k)], columns=["complex", "group", "observed", "fraction", "v", "m"])

    types = dict(members.dtypes)["complex"], dict(laws.dtypes)["group"]
    return x.groupBy("complex", "group").applyInPandas(merge, f"complex {types[0]}, group {types[1]}, observed double, fraction double, v array<double>, m array<double>")


def scored(laws: DataFrame, pairs: DataFrame, score: str = "arithmetic", min_fraction: float = 0.1) -> DataFrame:
    """(source, target, ligand, receptor, score, p) from laws (unit, group, ...): p that two independent summaries score as high.

    A task holds the laws of one pair, two a group, and compares every group with every group.
    """
    if score not in SCORES:
        raise ParameterError(f"unknown score {score}; known: {', '.join(SCORES)}")
    heard = laws.where(F.col("fraction") >= min_fraction)
    both = pairs.select("ligand", "receptor").distinct()
    sides = [both.join(heard.withColumnRenamed("unit", n), n).select("ligand", "receptor", F.lit(n).alias("side"), "group", "observed", "v", "m") for n in ("ligand", "receptor")]

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        left, right = ([*b[b["side"] == n][["group", "observed", "v", "m"]].itertuples(index=False)] for n in ("ligand", "receptor"))
        rows = []
        for one in left:
            for two in right:
                at = (one.observed + two.observed) / 2 if score == "arithmetic" else float(np.sqrt(max(0.0, one.observed) * max(0.0, two.observed)))
                rows.append((one.group, two.group, b["ligand"].iloc[0], b["receptor"].iloc[0], at, upper((one.v, one.m), (two.v, two.m), at, score)))
        return pd.DataFrame(rows, columns=["source", "target", "ligand", "receptor", "score", "p"])

    group, of = dict(laws.dtypes)["group"], dict(pairs.dtypes)
    schema = f"source {group}, target {group}, ligand {of['ligand']}, receptor {of['receptor']}, score double, p double"
    return sides[0].unionByName(sides[1]).groupBy("ligand", "receptor").applyInPandas(compare, schema)


def _units(laws: DataFrame, pairs: DataFrame, members: DataFrame | None, how: str) -> DataFrame:
    """Laws of genes and complexes under one name, of the type of the pairs' ends."""
    kind = dict(pairs.dtypes)["ligand"]
    rest = ("group", "observed", "fraction", "v", "m")
    out = laws.select(F.col("gene_id").cast(kind).alias("unit"), *rest)
    return out if members is None else out.unionByName(complex_laws(laws, members, how).select(F.col("complex").cast(kind).alias("unit"), *rest))


def _wanted(expr: DataFrame, pairs: DataFrame, members: DataFrame | None) -> DataFrame:
    kind = dict(pairs.dtypes)["ligand"]
    genes = pairs.select(F.col("ligand").alias("unit")).unionByName(pairs.select(F.col("receptor").alias("unit"))).distinct()
    if members is not None:
        inside = members.select(F.col("complex").cast(kind).alias("unit"), F.col("gene_id").cast(kind).alias("g")).join(genes, "unit", "left_semi").select(F.col("g").alias("unit"))
        genes = genes.unionByName(inside).distinct()
    return expr.join(genes, expr["gene_id"].cast(kind) == genes["unit"], "left_semi")


def analytic_p_values(expr: DataFrame, groups: DataFrame, pairs: DataFrame, members: DataFrame | None = None, summary: str = "mean", how: str = "min", score: str = "arithmetic", min_fraction: float = 0.1, finite: bool = True) -> DataFrame:
    """(source, target, ligand, receptor, score, p, q): pairs of genes or complexes scored between groups, with p without permutations.

    Both sides are taken as independent, as are the members of a complex: where the two genes go together in the cells of one
    group (source = target), permutations of labels give a wider law. p under 1e-12 is given as that. q is BH within each pair.
    """
    laws = group_laws(_wanted(expr, pairs, members), groups, summary, finite)
    if members is not None:
        laws = cut(laws)
    return stats.adjust(scored(_units(laws, pairs, members, how), pairs, score, min_fraction), "p", "q", "bh", ("ligand", "receptor"), ("source", "target"))


def combined_p_values(expr: DataFrame, groups: DataFrame, pairs: DataFrame, members: DataFrame | None = None, summaries: tuple[str, ...] = tuple(SUMMARIES), aggregates: tuple[str, ...] = AGGREGATES, scores: tuple[str, ...] = SCORES, min_fraction: float = 0.1, finite: bool = True) -> DataFrame:
    """(source, target, ligand, receptor, strength, p, q): the Cauchy combination of p over all settings, and the mean score.

    A gene's values are counted once for all summaries; without complexes the aggregates agree, and one is taken.
    """
    every = cut(all_laws(_wanted(expr, pairs, members), groups, summaries, finite))
    parts = []
    for summary in summaries:
        laws = every.where(F.col("summary") == summary).drop("summary")
        for how in aggregates if members is not None else aggregates[:1]:
            units = _units(laws, pairs, members, how)
            units = cut(units) if members is not None and len(scores) > 1 else units
            parts += [scored(units, pairs, score, min_fraction) for score in scores]
    scores_ = reduce(DataFrame.unionByName, parts)
    # A p of one is a pole of the tangent that would hide every other; it counts as 1 - 1 / settings.
    inside = F.when((F.col("p") >= 1 - LEAST) & F.lit(len(parts) > 1), F.lit(1.0 - 1.0 / len(parts))).otherwise(F.col("p"))
    out = scores_.groupBy("source", "target", "ligand", "receptor").agg(F.avg("score").alias("strength"), stats.cauchy_combination(inside).alias("p"))
    return stats.adjust(out.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))), "p", "q", "bh", ("ligand", "receptor"), ("source", "target"))
