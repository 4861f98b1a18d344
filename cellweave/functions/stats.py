"""Statistical expressions: normal tail, multiple testing, ranks, log-factorials, zero-aware moments."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.storage import cut

# Rational approximation of the normal tail to double precision (West 2005, after Hart 1968).
TAIL_NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal, as a JVM-side expression."""
    a = F.abs(z)
    poly = lambda cs: reduce(lambda acc, c: acc * a + F.lit(c), cs[1:], F.lit(cs[0]))
    e = F.exp(-a * a / 2)
    far = a + F.lit(1.0) / (a + F.lit(2.0) / (a + F.lit(3.0) / (a + F.lit(4.0) / (a + 0.65))))
    upper = F.when(a < 7.07106781186547, e * poly(TAIL_NUMERATOR) / poly(TAIL_DENOMINATOR)).otherwise(e / far / 2.506628274631)
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def normal_two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * normal_upper_tail(F.abs(z)))


def normal_quantile(p: float) -> float:
    """z with P(Z > z) = 1 - p."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


# Coefficients of Stirling's series for the logarithm of the gamma function.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: Stirling's series at x + 8, taken back by the recurrence."""
    y = x + 8.0
    back = reduce(lambda acc, k: acc * (x + float(k)), range(1, 8), x)
    series = reduce(lambda acc, c: acc / (y * y) + F.lit(c), reversed(STIRLING[:-1]), F.lit(STIRLING[-1])) / y
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(back)


def _rule(panels: int = 24, points: int = 7) -> list[tuple[float, float]]:
    """(place, weight) of a composite Gauss rule on the unit interval."""
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(points)
    return [((k + (xi + 1) / 2) / panels, wi / 2 / panels) for k in range(panels) for xi, wi in zip(x.tolist(), w.tolist(), strict=True)]


def student_two_sided(df: DataFrame, t: str = "t", freedom: str = "df", out: str = "p") -> DataFrame:
    """Adds the two-sided p of Student's t (null where t or the degrees of freedom are), to nine places for one degree of freedom and more.

    With t the tangent of an angle over the root of the degrees v, the tail is an integral of cos(angle)^(v - 1); in terms of
    the fourth root of the angle left to pi/2 it is smooth for small v, and for large v it is cut where nothing is left. Beyond
    10,000 degrees of freedom the normal tail of the corrected t, which agrees to eight places there.
    """
    v, tt = F.col(freedom).cast("double"), F.col(t) * F.col(t)
    left = F.lit(math.pi / 2) - F.atan(F.abs(F.col(t)) / F.sqrt(v))
    step = df.withColumns({"_b": F.pow(left, F.lit(0.25)), "_a": F.pow(F.greatest(F.lit(0.0), left - 7.5 / F.sqrt(v)), F.lit(0.25))})
    rule = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _rule()])
    a, size, power = F.col("_a"), F.col("_b") - F.col("_a"), v - 1.0
    at = lambda n: a + size * n["x"]
    area = F.aggregate(rule, F.lit(0.0), lambda acc, n: acc + n["w"] * 4.0 * at(n) * at(n) * at(n) * F.pow(F.sin(at(n) * at(n) * at(n) * at(n)), power))
    tail = 2.0 * size * area * F.exp(log_gamma((v + 1) / 2) - log_gamma(v / 2) - math.log(math.pi) / 2)
    wide = normal_two_sided(F.col(t) * (1 - 1 / (4 * v)) / F.sqrt(1 + tt / (2 * v)))
    p = F.when(v > 10_000, wide).otherwise(F.least(F.lit(1.0), tail))
    return step.withColumn(out, F.when(F.col(t).isNotNull() & v.isNotNull(), p)).drop("_a", "_b")


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: added up to 64, beyond by Euler's series, whose rest is then below the last digit."""
    few = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(m, F.lit(64))).cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / i)
    n = F.greatest(m, F.lit(1)).cast("double")
    s = 1.0 / (n * n)
    return F.when(m <= 64, few).otherwise(F.log(n) + 0.5772156649015329 + 0.5 / n - s * (1 / 12 - s * (1 / 120 - s / 252)))


def adjust(df: DataFrame, p: str = "p", out: str = "q", method: str = "bh", by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Adds adjusted p-values within ``by``: bh, by (Benjamini-Yekutieli), bonferroni or sidak. Null p stay null and do not count."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    m = F.count(p).over(part)
    if method == "bonferroni":
        return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * m))
    if method == "sidak":
        return df.withColumn(out, 1.0 - F.pow(1.0 - F.col(p), m))
    if method not in ("bh", "by"):
        raise ValueError(f"unknown correction {method}")
    ordered = part.orderBy(F.col(p).asc_nulls_last(), *order)
    step = df.withColumn("_rank", F.row_number().over(ordered)).withColumn("_m", m)
    factor = harmonic(F.col("_m")) if method == "by" else F.lit(1.0)
    step = step.withColumn("_step", F.least(F.lit(1.0), F.col(p) * F.col("_m") * factor / F.col("_rank")))
    down = part.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a running minimum: linear
    return step.withColumn(out, F.when(F.col(p).isNotNull(), F.min("_step").over(down))).drop("_rank", "_m", "_step")


def average_rank(value: str, by: tuple[str, ...]) -> Column:
    """Ascending rank with ties at their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*by, value)) - 1) / 2.0


def overall_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the rank over all rows, the largest value first (nulls last), ties at their mean.

    Distinct values are sorted by ranges and counted; the driver adds up a number for each range, and no task sees all rows.
    """
    order = F.col(value).desc_nulls_last()
    sizes = df.groupBy(value).agg(F.count("*").alias("_n"))
    ranged = cut(sizes.repartitionByRange(order).sortWithinPartitions(order).select(F.col(value).alias("_value"), "_n", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    starts, total = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("_part").agg(F.sum("_n")).collect())):
        starts.append((part, total))
        total += n
    before = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = ranged.withColumn("_upto", F.sum("_n").over(w)).join(F.broadcast(before), "_part")
    ranks = ranks.select("_value", (F.col("_start") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")


def zero_aware(expr: DataFrame, by: tuple[str, ...], n: Column, ddof: int = 0) -> DataFrame:
    """Mean and variance of groups that also hold implicit zeros: ``n`` observations in all, of which only non-zeros have rows."""
    s, q = F.sum("value"), F.sum(F.col("value") * F.col("value"))
    mean = s / n
    return expr.groupBy(*by).agg(mean.alias("mean"), F.greatest(F.lit(0.0), (q - s * s / n) / (n - ddof)).alias("var"))


def log_factorials(spark: SparkSession, top: int) -> DataFrame:
    """One row (lf): the array of ln k! for k = 0..top; top is the number of genes, so it is small."""
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = spark.range(0, top + 1, 1, 1).select(F.col("id").alias("k")).withColumn("lf", F.sum(F.when(F.col("k") > 0, F.log("k")).otherwise(0.0)).over(w))
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "lf"))), lambda s: s["lf"]).alias("lf"))


def hypergeometric_tail(tables: DataFrame, spark: SparkSession, genes: int) -> DataFrame:
    """Adds p = P(X >= a) for rows (a, set_size, query_size, background): a one-sided Fisher test.

    The log-factorials are one broadcast array, looked up by place; the sum runs over the counts from a to the most possible.
    """
    of = lambda k: F.get("lf", k.cast("int"))
    k_, n_, m_ = F.col("set_size"), F.col("query_size"), F.col("background")
    fixed = of(k_) + of(m_ - k_) + of(n_) + of(m_ - n_) - of(m_)
    hi = F.least(k_, n_)
    lo = F.greatest(F.col("a"), F.lit(0), k_ + n_ - m_)
    terms = F.transform(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")), lambda i: F.exp(F.col("_fixed") - of(i) - of(k_ - i) - of(n_ - i) - of(m_ - k_ - n_ + i)))
    out = tables.join(F.broadcast(log_factorials(spark, genes))).withColumn("_fixed", fixed)
    return out.withColumn("p", F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x))).drop("lf", "_fixed")


def cauchy_combination(p: Column) -> Column:
    """Aggregate: combined p-value of a group of (dependent) p-values."""
    return 0.5 - F.atan(F.avg(F.tan((0.5 - p) * F.lit(3.141592653589793)))) / F.lit(3.141592653589793)
