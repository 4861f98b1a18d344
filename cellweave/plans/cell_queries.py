"""Queries on cells and genes: quality control, normalisation, markers, pseudobulk, enrichment, deconvolution, layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import stats
from cellweave.operators import deconvolution, dispersion, dynamics, enrichment, factors, integration, marker_mixture, markers, neighbors, plotdata, preprocess, profile, regularised
from cellweave.plans import proxy
from cellweave.plans.proxy import query, r6, sql_bh, sql_normal_p, sql_student_p


@query("SELECT obs_id, n_genes, round(total, 6) AS total, round(ln(1 + total), 6) AS log1p_total, round(100.0 * tm / total, 6) AS pct_mt, round(100.0 * tr / total, 6) AS pct_ribo FROM (SELECT obs_id, count(*) FILTER (value > 0) AS n_genes, sum(value) AS total, sum(CASE WHEN mt THEN value ELSE 0 END) AS tm, sum(CASE WHEN ribo THEN value ELSE 0 END) AS tr FROM counts JOIN genes USING (gene_id) GROUP BY 1)")
def qc_per_cell(s, d):
    return preprocess.qc_per_cell(proxy.counts(s, d), proxy.genes(s, d)).select("obs_id", "n_genes", r6("total"), r6("log1p_total"), r6("pct_mt"), r6("pct_ribo"))


@query("SELECT gene_id, n_cells, round(total, 6) AS total, round(total / n, 6) AS mean, round(100.0 * (1 - n_cells / n), 6) + 0.0 AS pct_dropout FROM (SELECT gene_id, count(*) FILTER (value > 0) AS n_cells, sum(value) AS total, (SELECT count(*)::DOUBLE FROM cells) AS n FROM counts GROUP BY 1)")
def qc_per_gene(s, d):
    return preprocess.qc_per_gene(proxy.counts(s, d), proxy.cells(s, d).count()).select("gene_id", "n_cells", r6("total"), r6("mean"), r6("pct_dropout"))


@query("SELECT obs_id, CAST(top AS INTEGER) AS top, round(100.0 * sum(value) FILTER (r <= top) / sum(value), 6) AS pct FROM (SELECT obs_id, value, row_number() OVER (PARTITION BY obs_id ORDER BY value DESC, gene_id) AS r FROM counts), (SELECT unnest([50, 100, 200, 500]) AS top) GROUP BY 1, 2")
def pct_top_n(s, d):
    return preprocess.top_share(proxy.counts(s, d), [50, 100, 200, 500]).select("obs_id", "top", r6("pct"))


@query("SELECT count(*) AS n_cells, median(n_genes)::DOUBLE AS median_genes, round(median(total), 6) AS median_total, round(median(pct), 6) AS median_pct_mt, round(max(pct), 6) AS max_pct_mt FROM (SELECT obs_id, count(*) AS n_genes, sum(value) AS total, 100.0 * sum(CASE WHEN mt THEN value ELSE 0 END) / sum(value) AS pct FROM counts JOIN genes USING (gene_id) GROUP BY 1)")
def qc_summary(s, d):
    q = preprocess.qc_summary(preprocess.qc_per_cell(proxy.counts(s, d), proxy.genes(s, d)))
    return q.select("n_cells", "median_genes", r6("median_total"), r6("median_pct_mt"), r6("max_pct_mt"))


_KEPT = "SELECT obs_id, gene_id, value FROM ocounts WHERE gene_id IN (SELECT gene_id FROM ocounts GROUP BY 1 HAVING count(*) >= 3)"


@query(f"SELECT obs_id, gene_id, value FROM ({_KEPT}) WHERE obs_id IN (SELECT obs_id FROM ({_KEPT}) GROUP BY 1 HAVING count(*) >= 3)")
def filter_genes_cells(s, d):
    return preprocess.filter_cells(preprocess.filter_genes(proxy.order_counts(s, d), 3), 3)


@query("SELECT obs_id, gene_id, value FROM ocounts WHERE obs_id NOT IN (SELECT obs_id FROM ocounts JOIN genes USING (gene_id) GROUP BY 1 HAVING 100.0 * sum(CASE WHEN mt THEN value ELSE 0 END) / sum(value) > 40)")
def mito_filter(s, d):
    c = proxy.order_counts(s, d)
    return preprocess.filter_mito(c, preprocess.qc_per_cell(c, proxy.genes(s, d)), 40.0)


@query("SELECT s_suppkey AS obs_id FROM supplier ORDER BY md5('42:' || CAST(s_suppkey AS VARCHAR)), s_suppkey LIMIT 40")
def subsample_cells(s, d):
    return preprocess.subsample(proxy.cells(s, d), 40).select("obs_id")


@query("SELECT obs_id, gene_id, round(value, 6) AS value FROM lognorm")
def normalize_log1p(s, d):
    return preprocess.normalise(proxy.counts(s, d)).select("obs_id", "gene_id", r6("value"))


@query("SELECT obs_id, gene_id, round(greatest(-sqrt(n), least(sqrt(n), (coalesce(value, 0) - mu) / sqrt(mu + mu * mu / 100))), 6) + 0.0 AS residual FROM (SELECT o.obs_id, g.gene_id, c.value, r * k / s AS mu, n FROM (SELECT obs_id, sum(value) AS r FROM counts GROUP BY 1) o CROSS JOIN (SELECT gene_id, sum(value) AS k FROM counts GROUP BY 1) g CROSS JOIN (SELECT sum(value) AS s, (SELECT count(*)::DOUBLE FROM cells) AS n FROM counts) LEFT JOIN counts c ON c.obs_id = o.obs_id AND c.gene_id = g.gene_id)")
def pearson_residuals(s, d):
    c = proxy.counts(s, d)
    return preprocess.pearson_residuals(c, proxy.cells(s, d), c.select("gene_id").distinct()).select("obs_id", "gene_id", r6("residual"))


_DEPTH = "(SELECT obs_id, sum(value) AS d FROM counts GROUP BY 1)"
_NB_RAW = f"(SELECT gene_id, k, share, exp(l / (SELECT count(*) FROM cells)) - 1 AS gmean, CASE WHEN extra > 0 THEN squares / extra END AS raw_theta FROM (SELECT *, q - 2 * share * xd + squares - t AS extra FROM (SELECT *, t / s AS share, t / s * (t / s) * dd AS squares FROM (SELECT gene_id, sum(value) AS t, sum(value * value) AS q, sum(value * d) AS xd, sum(ln(1 + value)) AS l, count(*) AS k FROM counts JOIN {_DEPTH} USING (obs_id) GROUP BY 1), (SELECT sum(d) AS s, sum(d * d) AS dd FROM {_DEPTH}))))"
_NB = f"(SELECT gene_id, share, gmean, raw_theta, CASE WHEN raw_theta IS NOT NULL THEN gmean / (power(10, smooth) - 1) END AS theta FROM (WITH raw AS MATERIALIZED (SELECT *, log10(gmean) AS place, log10(1 + gmean / raw_theta) AS o FROM {_NB_RAW}), fitted AS (SELECT * FROM raw WHERE k >= 5 AND o IS NOT NULL), span AS (SELECT greatest(1e-3, 2.7 * stddev_samp(place) * power(count(*), -0.2)) AS h, min(place) AS low, max(place) AS high FROM fitted), bins AS (SELECT avg(place) AS centre, sum(o) AS o, count(*) AS n FROM fitted, span GROUP BY floor(place / (h / 16))) SELECT raw.gene_id, any_value(share) AS share, any_value(gmean) AS gmean, any_value(raw_theta) AS raw_theta, sum(w * b_o) / sum(w * b_n) AS smooth FROM (SELECT raw.*, bins.o AS b_o, bins.n AS b_n, exp(-0.5 * power((greatest(low, least(high, place)) - centre) / h, 2)) AS w FROM raw, span, bins) raw GROUP BY 1))"


@query(f"SELECT gene_id, round(share, 9) AS share, round(gmean, 6) AS gmean, round(raw_theta, 6) AS raw_theta, round(theta, 6) AS theta FROM {_NB}")
def regularised_model(s, d):
    t = regularised.model(proxy.counts(s, d), proxy.cells(s, d))
    return t.select("gene_id", F.round("share", 9).alias("share"), r6("gmean"), r6("raw_theta"), r6("theta"))


@query(f"SELECT o.obs_id, g.gene_id, round(greatest(-sqrt(n), least(sqrt(n), (coalesce(value, 0) - mu) / sqrt(mu + coalesce(mu * mu / theta, 0)))), 5) + 0.0 AS residual FROM {_DEPTH} o CROSS JOIN {_NB} g CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM cells), LATERAL (SELECT d * share AS mu) LEFT JOIN counts c ON c.obs_id = o.obs_id AND c.gene_id = g.gene_id")
def regularised_residuals(s, d):
    c = proxy.counts(s, d)
    return regularised.residuals(c, proxy.cells(s, d), c.select("gene_id")).select("obs_id", "gene_id", (F.round("residual", 5) + 0.0).alias("residual"))


@query("SELECT gene_id, round(lm, 6) AS mean, round(disp, 6) + 0.0 AS dispersion, bin, round(CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE (disp - av) / sd END, 4) + 0.0 AS norm_dispersion FROM (SELECT *, avg(disp) OVER (PARTITION BY bin) AS av, stddev_samp(disp) OVER (PARTITION BY bin) AS sd FROM (SELECT gene_id, lm, disp, CAST(least(20, floor((lm - min(lm) OVER ()) / ((max(lm) OVER () - min(lm) OVER ()) / 20)) + 1) AS INTEGER) AS bin FROM (SELECT gene_id, ln(1 + s / n) AS lm, CASE WHEN (q - s * s / n) > 0 THEN ln((q - s * s / n) / (n - 1) / (s / n)) END AS disp FROM (SELECT gene_id, sum(exp(value) - 1) AS s, sum((exp(value) - 1) * (exp(value) - 1)) AS q, (SELECT count(*)::DOUBLE FROM cells) AS n FROM lognorm GROUP BY 1))))")
def gene_dispersion_bins(s, d):
    g = preprocess.gene_dispersion(preprocess.normalise(proxy.counts(s, d)), proxy.cells(s, d).count())
    return g.select("gene_id", r6("mean"), r6("dispersion"), "bin", (F.round("norm_dispersion", 4) + 0.0).alias("norm_dispersion"))


@query("SELECT gene_id, round(sqrt(greatest(0, q / n - s / n * s / n)) / (s / n), 6) AS cv FROM (SELECT gene_id, sum(value) AS s, sum(value * value) AS q, (SELECT count(*)::DOUBLE FROM cells) AS n FROM counts GROUP BY 1)")
def gene_cv(s, d):
    return preprocess.gene_cv(proxy.counts(s, d), proxy.cells(s, d).count()).select("gene_id", r6("cv"))


@query("SELECT gene_id, count(*) FILTER (value > 0) AS n_expressed, sum(value) AS total FROM counts GROUP BY 1 HAVING count(*) FILTER (value > 0) >= ceil((SELECT count(*) FROM cells) * 0.25) AND sum(value) >= 10")
def spatial_gene_filter(s, d):
    return preprocess.spatial_gene_filter(proxy.counts(s, d), proxy.cells(s, d).count(), 0.25, 10.0)


@query("SELECT gene_id, round(sum(value) / (SELECT count(*) FROM cells), 6) AS mean FROM counts GROUP BY 1 ORDER BY sum(value) DESC, gene_id LIMIT 10")
def top_expressed_genes(s, d):
    return profile.top_expressed(proxy.counts(s, d), proxy.cells(s, d).count()).select("gene_id", r6("mean"))


@query("SELECT 'p_name' AS \"column\", 'categorical' AS kind, count(DISTINCT p_name) AS n_unique, NULL::DOUBLE AS min, NULL::DOUBLE AS max, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT p_name AS v FROM part ORDER BY v LIMIT CASE WHEN (SELECT count(DISTINCT p_name) FROM part) > 100 THEN 3 ELSE 5 END)) AS samples FROM part UNION ALL SELECT 'p_type', 'categorical', count(DISTINCT p_type), NULL, NULL, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT p_type AS v FROM part ORDER BY v LIMIT 5)) FROM part UNION ALL SELECT 'p_size', 'numeric', count(DISTINCT p_size), min(p_size)::DOUBLE, max(p_size)::DOUBLE, NULL FROM part UNION ALL SELECT 'p_retailprice', 'numeric', count(DISTINCT p_retailprice), min(p_retailprice), max(p_retailprice), NULL FROM part")
def column_profile(s, d):
    return profile.columns(proxy.table(s, d, "part").select("p_name", "p_type", "p_size", "p_retailprice"))


@query("SELECT count(*) FILTER (regexp_matches(name, '^(red|blue)')) AS n, round(avg(CASE WHEN regexp_matches(name, '^(red|blue)') THEN 1.0 ELSE 0 END), 6) AS share FROM genes")
def housekeeping_share(s, d):
    return profile.name_share(proxy.genes(s, d), "^(red|blue)").select("n", r6("share"))


@query("SELECT gene_id FROM counts WHERE obs_id % 3 = 0 INTERSECT SELECT gene_id FROM counts WHERE obs_id % 3 = 1 INTERSECT SELECT gene_id FROM counts WHERE obs_id % 3 = 2")
def common_genes(s, d):
    c = proxy.counts(s, d)
    return integration.common_genes([c.where(F.col("obs_id") % 3 == i) for i in range(3)])


# --- markers -------------------------------------------------------------------------------------------------------


def _t_sql(b: str) -> str:
    """t, df, p and q of each group against the rest in SQL; ``b`` is the size that divides the rest's variance."""
    a1, a2 = "v1 / n1", f"v2 / {b}"
    t = f"SELECT gene_id, grp, (m1 - m2) / sqrt({a1} + {a2}) AS t, ({a1} + {a2}) * ({a1} + {a2}) / ({a1} * {a1} / (n1 - 1) + {a2} * {a2} / ({b} - 1)) AS df FROM gmom WHERE {a1} + {a2} > 0"
    inner, outer = sql_bh("p", "grp", "gene_id")
    return f"SELECT *, {outer} AS q FROM (SELECT *, {inner} FROM (SELECT *, {sql_student_p('t', 'df')} AS p FROM ({t})))"


def _t_rows(t):
    return t.select("gene_id", "group", (F.round("t", 5) + 0.0).alias("t"), F.round("df", 4).alias("df"), F.round("p", 5).alias("p"), F.round("q", 5).alias("q"))


@query(f"SELECT gene_id, grp AS \"group\", round(t, 5) + 0.0 AS t, round(df, 4) AS df, round(p, 5) AS p, round(q, 5) AS q FROM ({_t_sql('n2')})")
def ttest_markers(s, d):
    return _t_rows(markers.t_test(preprocess.normalise(proxy.counts(s, d)), proxy.cells(s, d)))


@query(f"SELECT gene_id, grp AS \"group\", round(t, 5) + 0.0 AS t, round(df, 4) AS df, round(p, 5) AS p, round(q, 5) AS q FROM ({_t_sql('n1')})")
def ttest_overestim(s, d):
    return _t_rows(markers.t_test(preprocess.normalise(proxy.counts(s, d)), proxy.cells(s, d), overestimate=True))


_WILCOXON = "SELECT gene_id, grp, (r1 - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM (SELECT gene_id, grp, sum(rk) AS r1, count(*)::DOUBLE AS n1, (SELECT count(*) FROM cells) - count(*)::DOUBLE AS n2 FROM (SELECT gene_id, grp, rank() OVER (PARTITION BY gene_id ORDER BY v) + (count(*) OVER (PARTITION BY gene_id, v) - 1) / 2.0 AS rk FROM (SELECT g.gene_id, c.grp, coalesce(value, 0) AS v FROM (SELECT DISTINCT gene_id FROM counts) g CROSS JOIN cells c LEFT JOIN lognorm l ON l.gene_id = g.gene_id AND l.obs_id = c.obs_id)) GROUP BY 1, 2)"


def _wilcoxon_q(z: str) -> str:
    inner, outer = sql_bh("p", "grp", "gene_id")
    return f"SELECT *, {outer} AS q FROM (SELECT *, {inner} FROM (SELECT *, {sql_normal_p('z')} AS p FROM ({z})))"


@query(f"SELECT gene_id, grp AS \"group\", round(z, 5) + 0.0 AS z, round(p, 5) AS p, round(q, 5) AS q FROM ({_wilcoxon_q(_WILCOXON)})")
def wilcoxon_markers(s, d):
    w = markers.wilcoxon(preprocess.normalise(proxy.counts(s, d)), proxy.cells(s, d))
    return w.select("gene_id", "group", (F.round("z", 5) + 0.0).alias("z"), F.round("p", 5).alias("p"), F.round("q", 5).alias("q"))


_PAIR = _WILCOXON.replace("FROM cells)", "FROM cells WHERE grp IN (1, 3))").replace("(SELECT DISTINCT gene_id FROM counts)", "(SELECT DISTINCT gene_id FROM counts JOIN cells USING (obs_id) WHERE grp IN (1, 3))").replace("CROSS JOIN cells c", "CROSS JOIN (SELECT * FROM cells WHERE grp IN (1, 3)) c")


@query(f"SELECT gene_id, grp AS \"group\", round(z, 5) + 0.0 AS z, round(p, 5) AS p, round(q, 5) AS q FROM ({_wilcoxon_q(_PAIR)}) WHERE grp = 1")
def markers_pairwise(s, d):
    w = markers.pairwise(preprocess.normalise(proxy.counts(s, d)), proxy.cells(s, d), 1, 3)
    return w.select("gene_id", "group", (F.round("z", 5) + 0.0).alias("z"), F.round("p", 5).alias("p"), F.round("q", 5).alias("q"))


_TOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY grp) AS seen FROM (SELECT gene_id, grp, row_number() OVER (PARTITION BY grp ORDER BY round(z, 5) DESC, gene_id) AS rank FROM ({_WILCOXON})) WHERE rank <= 25) WHERE seen = 1"


@query(f"SELECT grp AS \"group\", CAST(rank AS INTEGER) AS rank, gene_id FROM ({_TOP}) ORDER BY grp, rank LIMIT 60")
def marker_topn_dedup(s, d):
    z = markers.wilcoxon(preprocess.normalise(proxy.counts(s, d)), proxy.cells(s, d)).withColumn("z", F.round("z", 5))
    return markers.top_markers(z, 25, total=60).select("group", "rank", "gene_id")


_FOLD = "SELECT gene_id, grp, log2((s1 / n1 + 1) / ((s - s1) / n2 + 1)) AS log2fc FROM (SELECT t.gene_id, g.grp, coalesce(s1, 0) AS s1, s, n1, (SELECT count(*) FROM cells) - n1 AS n2 FROM (SELECT gene_id, sum(exp(value) - 1) AS s FROM lognorm GROUP BY 1) t CROSS JOIN (SELECT grp, count(*)::DOUBLE AS n1 FROM cells GROUP BY 1) g LEFT JOIN (SELECT gene_id, grp, sum(exp(value) - 1) AS s1 FROM lognorm JOIN cells USING (obs_id) GROUP BY 1, 2) x ON x.gene_id = t.gene_id AND x.grp = g.grp)"


@query(f"SELECT grp AS \"group\", (SELECT count(*) FROM cells c WHERE c.grp = t.grp) AS n_cells, count(*) AS n_markers, round(avg(log2fc), 5) + 0.0 AS mean_log2fc, round(median(q), 5) AS median_q, abs(avg(log2fc)) > 10 AS suspicious FROM ({_TOP}) t JOIN ({_wilcoxon_q(_WILCOXON)}) w USING (gene_id, grp) JOIN ({_FOLD}) f USING (gene_id, grp) GROUP BY 1")
def marker_summary(s, d):
    n, groups = preprocess.normalise(proxy.counts(s, d)), proxy.cells(s, d)
    tested = markers.wilcoxon(n, groups).withColumn("z", F.round("z", 5))
    out = markers.marker_summary(tested, markers.log2_fold_change(proxy.counts(s, d), groups), groups, markers.top_markers(tested, 25))
    return out.select("group", "n_cells", "n_markers", (F.round("mean_log2fc", 5) + 0.0).alias("mean_log2fc"), F.round("median_q", 5).alias("median_q"), "suspicious")


@query("SELECT grp AS \"group\", count(*) AS n FROM cells GROUP BY 1")
def group_counts(s, d):
    return markers.group_counts(proxy.cells(s, d))


@query("SELECT condition, count(*) AS n_samples FROM (SELECT sample, first(condition ORDER BY obs_id) AS condition FROM samples GROUP BY 1) GROUP BY 1")
def sample_conditions(s, d):
    return markers.sample_conditions(proxy.samples(s, d), 1)


@query("SELECT obs_id, gene_id, value FROM counts JOIN cells USING (obs_id) WHERE grp IN (1, 3)")
def group_subset(s, d):
    return proxy.counts(s, d).join(markers.in_groups(proxy.cells(s, d), [1, 3]), "obs_id", "left_semi")


@query("SELECT gene_id, grp AS \"group\", round(log2((s1 / n1 + 1) / ((s - s1) / n2 + 1)), 6) + 0.0 AS log2fc FROM (SELECT t.gene_id, g.grp, coalesce(s1, 0) AS s1, s, n1, (SELECT count(*) FROM cells) - n1 AS n2 FROM (SELECT gene_id, sum(exp(value) - 1) AS s FROM lognorm GROUP BY 1) t CROSS JOIN (SELECT grp, count(*)::DOUBLE AS n1 FROM cells GROUP BY 1) g LEFT JOIN (SELECT gene_id, grp, sum(exp(value) - 1) AS s1 FROM lognorm JOIN cells USING (obs_id) GROUP BY 1, 2) x ON x.gene_id = t.gene_id AND x.grp = g.grp)")
def log2fc_raw(s, d):
    return markers.log2_fold_change(proxy.counts(s, d), proxy.cells(s, d)).select("gene_id", "group", r6("log2fc"))


@query("SELECT item, grp AS \"group\", round(min(step) OVER (PARTITION BY grp ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS q FROM (SELECT p_partkey AS item, p_size % 5 AS grp, row_number() OVER w AS rk, least(1, p * count(*) OVER (PARTITION BY p_size % 5) / row_number() OVER w) AS step FROM (SELECT p_partkey, p_size, (p_retailprice - 899) / 2500 AS p FROM part) WINDOW w AS (PARTITION BY p_size % 5 ORDER BY p, p_partkey))")
def bh_fdr(s, d):
    t = proxy.table(s, d, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") % 5).alias("group"), ((F.col("p_retailprice") - 899) / 2500).alias("p"))
    return stats.adjust(t, "p", "q", "bh", ("group",), ("item",)).select("item", "group", r6("q"))


@query("SELECT sample, condition, gene_id, sum(value) AS value FROM ocounts JOIN samples USING (obs_id) GROUP BY 1, 2, 3")
def pseudobulk(s, d):
    return markers.pseudobulk(proxy.order_counts(s, d), proxy.samples(s, d), min_cells=1).select("sample", "condition", "gene_id", "value")


@query("SELECT sample, condition, cell_type, gene_id, sum(value) AS value FROM ocounts JOIN samples USING (obs_id) GROUP BY 1, 2, 3, 4")
def pseudobulk_strat(s, d):
    return markers.pseudobulk(proxy.order_counts(s, d), proxy.samples(s, d), ("sample", "condition", "cell_type"), 1).select("sample", "condition", "cell_type", "gene_id", "value")


def _bulk(s, d):
    return markers.pseudobulk(proxy.order_counts(s, d), proxy.samples(s, d), min_cells=1)


@query("SELECT sample, round(size_factor, 6) AS size_factor FROM factors")
def deseq_size_factors(s, d):
    return markers.size_factors(_bulk(s, d), positive=True).select("sample", r6("size_factor"))


_CONDITION = "SELECT {by}gene_id, sa / na AS mean_a, sb / nb AS mean_b, log2((sa / na + 1) / (sb / nb + 1)) AS log2fc FROM (SELECT gene_id, sum(CASE WHEN condition = 0 THEN value / size_factor ELSE 0 END) AS sa, sum(CASE WHEN condition = 1 THEN value / size_factor ELSE 0 END) AS sb, (SELECT count(DISTINCT sample)::DOUBLE FROM bulk WHERE condition = 0) AS na, (SELECT count(DISTINCT sample)::DOUBLE FROM bulk WHERE condition = 1) AS nb FROM bulk JOIN factors USING (sample) GROUP BY 1)"


@query(f"SELECT gene_id, round(mean_a, 5) AS mean_a, round(mean_b, 5) AS mean_b, round(log2fc, 5) + 0.0 AS log2fc FROM ({_CONDITION.format(by='')})")
def condition_log2fc(s, d):
    b = _bulk(s, d)
    f = markers.condition_fold_change(b, markers.size_factors(b, positive=True), 0, 1)
    return f.select("gene_id", F.round("mean_a", 5).alias("mean_a"), F.round("mean_b", 5).alias("mean_b"), (F.round("log2fc", 5) + 0.0).alias("log2fc"))


@query(f"SELECT direction, CAST(row_number() OVER (PARTITION BY direction ORDER BY round(abs(log2fc), 9) DESC, gene_id) AS INTEGER) AS rank, gene_id FROM (SELECT *, CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END AS direction FROM (SELECT gene_id, log2fc, (gene_id % 100) / 1000.0 AS q FROM ({_CONDITION.format(by='')}))) WHERE q < 0.05 AND abs(log2fc) > 0.5")
def regulated_genes(s, d):
    """Fold changes with a q of the gene's number, so that SQL can follow the lists."""
    b = _bulk(s, d)
    f = markers.condition_fold_change(b, markers.size_factors(b, positive=True), 0, 1).withColumns({"q": (F.col("gene_id") % 100) / 1000.0, "log2fc": F.round("log2fc", 9)})
    return markers.regulated(f, 0.05, 0.5).select("direction", "rank", "gene_id")


@query()
def condition_wald(s, d):
    b = _bulk(s, d)
    return markers.negative_binomial_wald(b, markers.size_factors(b, positive=True), 0, 1)


@query()
def condition_wald_by_type(s, d):
    return markers.wald_by_stratum(proxy.order_counts(s, d), proxy.samples(s, d), 0, 1, min_cells=1)


@query("SELECT item, round(least(1, p * n), 6) AS bonferroni, round(1 - power(1 - p, n), 6) AS sidak, round(min(step) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS yekutieli FROM (SELECT *, least(1, p * n * h / rk) AS step FROM (SELECT p_partkey AS item, (p_retailprice - 899) / 2500 AS p, count(*) OVER () AS n, row_number() OVER (ORDER BY (p_retailprice - 899) / 2500, p_partkey) AS rk FROM part), (SELECT sum(1.0::DOUBLE / i) AS h FROM range(1, (SELECT count(*) + 1 FROM part)) t(i)))")
def other_corrections(s, d):
    t = proxy.table(s, d, "part").select(F.col("p_partkey").alias("item"), ((F.col("p_retailprice") - 899) / 2500).alias("p"))
    for name, method in (("bonferroni", "bonferroni"), ("sidak", "sidak"), ("yekutieli", "by")):
        t = stats.adjust(t, "p", name, method, (), ("item",))
    return t.select("item", r6("bonferroni"), r6("sidak"), r6("yekutieli"))


@query("SELECT gene_id, regexp_matches(gene_id, '^(MT-|mt-)') AS mt, regexp_matches(gene_id, '^(RPS|RPL|Rps|Rpl)') AS ribo FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'MT-' WHEN p_partkey % 11 = 0 THEN 'mt-' WHEN p_partkey % 5 = 0 THEN 'RPS' WHEN p_partkey % 3 = 0 THEN 'xRPL' ELSE 'Rpl' END || CAST(p_partkey AS VARCHAR) AS gene_id FROM part)")
def gene_flags(s, d):
    k = F.col("p_partkey")
    prefix = F.when(k % 7 == 0, "MT-").when(k % 11 == 0, "mt-").when(k % 5 == 0, "RPS").when(k % 3 == 0, "xRPL").otherwise("Rpl")
    return preprocess.flag_genes(proxy.table(s, d, "part").select(F.concat(prefix, k.cast("string")).alias("gene_id")))


@query("SELECT * FROM (SELECT grp AS \"group\", gene_id, unnest(['mean', 'median', 'q3', 'trimean']) AS summary, unnest([round(avg(v), 6), round(quantile_cont(v, 0.5), 6), round(quantile_cont(v, 0.75), 6), round((quantile_cont(v, 0.25) + 2 * quantile_cont(v, 0.5) + quantile_cont(v, 0.75)) / 4, 6)]) AS value FROM (SELECT grp, g.gene_id, coalesce(value, 0) AS v FROM cells c CROSS JOIN (SELECT DISTINCT gene_id FROM counts) g LEFT JOIN counts x ON x.obs_id = c.obs_id AND x.gene_id = g.gene_id) GROUP BY 1, 2 HAVING max(v) > 0)")
def group_quantiles(s, d):
    from cellweave.operators import communication

    return communication.summaries(proxy.counts(s, d), proxy.cells(s, d)).select("group", "gene_id", "summary", r6("value"))


@query("SELECT grp AS \"group\", 'k' || CAST(gene_id // 3 AS VARCHAR) AS complex, round(min(m), 6) AS mean FROM (SELECT grp, gene_id, sum(value) / (SELECT count(*) FROM cells c WHERE c.grp = x.grp) AS m FROM counts JOIN cells x USING (obs_id) GROUP BY 1, 2) JOIN (SELECT p_partkey // 3 AS k, count(*) AS size FROM part GROUP BY 1) ON k = gene_id // 3 GROUP BY 1, 2 HAVING count(*) = any_value(size)")
def complex_means(s, d):
    from cellweave.operators import communication

    members = proxy.table(s, d, "part").select(F.concat(F.lit("k"), F.expr("p_partkey div 3").cast("string")).alias("complex"), F.col("p_partkey").alias("gene_id"))
    return communication.complexes(communication.group_means(proxy.counts(s, d), proxy.cells(s, d)), members).select("group", "complex", r6("mean"))


# --- enrichment ----------------------------------------------------------------------------------------------------


def _ranking(s, d):
    groups = proxy.cells(s, d).where("group in (0, 1)")
    return enrichment.signal_to_noise(preprocess.normalise(proxy.counts(s, d)), groups, 0, 1)


@query("SELECT gene_id, round(score, 6) + 0.0 AS score FROM (SELECT gene_id, score FROM ranked) WHERE gene_id IN (SELECT gene_id FROM counts JOIN cells USING (obs_id) WHERE grp IN (0, 1))")
def signal_to_noise(s, d):
    return _ranking(s, d).select("gene_id", r6("score"))


_ORA = "SELECT set_name, a, k, n, m FROM (SELECT set_name, count(*) FILTER (hit) AS a, count(*) AS k, (SELECT count(*) FROM q) AS n, (SELECT count(*) FROM genes) AS m FROM (SELECT set_name, gene_id IN (SELECT gene_id FROM q) AS hit FROM genes) GROUP BY 1)".replace(" q)", " (SELECT gene_id FROM counts GROUP BY 1 ORDER BY sum(value) DESC, gene_id LIMIT 100) q)")
_LC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
_TERM = "exp(" + _LC.format(n="k", k="i") + " + " + _LC.format(n="(m - k)", k="(n - i)") + " - " + _LC.format(n="m", k="n") + ")"


_ORA_P = f"SELECT set_name, a AS overlap, k AS set_size, CASE WHEN (n - a) * (k - a) > 0 THEN a * (m - n - k + a)::DOUBLE / ((n - a) * (k - a)) END AS odds_ratio, least(1, sum({_TERM})) AS p FROM ({_ORA}), range(0, 101) t(i) WHERE i >= a AND i <= least(k, n) AND m - k >= n - i GROUP BY set_name, a, k, n, m"
_ORA_Q = f"SELECT *, {sql_bh('p', '', 'set_name')[1]} AS q FROM (SELECT *, {sql_bh('p', '', 'set_name')[0]} FROM ({_ORA_P}))"


def _ora(s, d):
    c = proxy.counts(s, d)
    top = c.groupBy("gene_id").agg(F.sum("value").alias("t")).orderBy(F.col("t").desc(), "gene_id").limit(100)
    g = proxy.genes(s, d)
    return enrichment.over_representation(top, g, g, 1, 1_000_000)


@query(f"SELECT set_name, overlap, set_size, round(odds_ratio, 6) AS odds_ratio, round(p, 6) AS p, round(q, 6) AS q FROM ({_ORA_Q})")
def ora_fisher(s, d):
    return _ora(s, d).select("set_name", "overlap", "set_size", r6("odds_ratio"), r6("p"), r6("q"))


@query(f"SELECT count(*) AS n_tested, count(*) FILTER (q < 0.25) AS n_kept, count(*) FILTER (q < 0.05) AS n_significant FROM ({_ORA_Q})")
def significance_counts(s, d):
    return enrichment.significance_counts(_ora(s, d), "gsea")


@query(f"SELECT set_name, CAST(row_number() OVER (ORDER BY round(q, 9), set_name) AS INTEGER) AS rank, round(-log10(greatest(round(q, 9), 1e-300)), 6) + 0.0 AS neg_log10 FROM ({_ORA_Q}) ORDER BY round(q, 9), set_name LIMIT 10")
def best_sets(s, d):
    return enrichment.best_sets(_ora(s, d).withColumn("q", F.round("q", 9)), 10).select("set_name", "rank", r6("neg_log10"))


@query("SELECT set_name, round(CASE WHEN up >= -down THEN up ELSE down END, 5) + 0.0 AS es FROM (SELECT set_name, max(run) AS up, min(run) AS down FROM (SELECT s.set_name, sum(CASE WHEN g.set_name = s.set_name THEN abs(score) / tot ELSE -1.0 / (n - size) END) OVER (PARTITION BY s.set_name ORDER BY r.pos) AS run FROM (SELECT gene_id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, gene_id) AS pos, count(*) OVER () AS n FROM ranked WHERE gene_id IN (SELECT gene_id FROM counts JOIN cells USING (obs_id) WHERE grp IN (0, 1))) r JOIN (SELECT gene_id, set_name FROM genes) g USING (gene_id) CROSS JOIN (SELECT set_name, sum(abs(round(score, 9))) AS tot, count(*) AS size FROM ranked JOIN genes USING (gene_id) WHERE gene_id IN (SELECT gene_id FROM counts JOIN cells USING (obs_id) WHERE grp IN (0, 1)) GROUP BY 1) s) GROUP BY 1)")
def gsea_es(s, d):
    r = _ranking(s, d).withColumn("score", F.round("score", 9))
    return enrichment.running_score(r, proxy.genes(s, d).select("set_name", "gene_id")).select("set_name", (F.round("es", 5) + 0.0).alias("es"))


_RANKED = "(SELECT gene_id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, gene_id) AS pos, count(*) OVER () AS n FROM ranked WHERE gene_id IN (SELECT gene_id FROM counts JOIN cells USING (obs_id) WHERE grp IN (0, 1)))"
_HITS = "SELECT {key}set_name, cum / tot - (pos - k) / (n - size) AS after, (cum - wt) / tot - (pos - k) / (n - size) AS before FROM (SELECT {key}set_name, pos, wt, n, row_number() OVER (w ORDER BY pos) AS k, sum(wt) OVER (w ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum, sum(wt) OVER w AS tot, count(*) OVER w::DOUBLE AS size FROM {hits} WINDOW w AS (PARTITION BY {key}set_name))"
_ES = "SELECT {key}set_name, CASE WHEN max(after) >= -min(before) THEN max(after) ELSE min(before) END AS es FROM ({hits}) GROUP BY ALL"
_DRAW = "(SELECT a.perm, g.set_name, a.pos, a.wt, a.n FROM (SELECT perm, pos, abs(score) AS wt, n FROM r, range(1, 1001) t(perm)) a JOIN (SELECT perm, gene_id, row_number() OVER (PARTITION BY perm ORDER BY md5('42:' || CAST(perm AS VARCHAR) || ':' || CAST(gene_id AS VARCHAR)), gene_id) AS pos FROM r, range(1, 1001) t(perm)) b USING (perm, pos) JOIN genes g ON g.gene_id = b.gene_id)"
_GSEA = (
    f"WITH r AS MATERIALIZED (SELECT * FROM {_RANKED}), o AS MATERIALIZED ({_ES.format(key='', hits=_HITS.format(key='', hits='(SELECT set_name, pos, abs(score) AS wt, n FROM r JOIN (SELECT gene_id, set_name FROM genes) USING (gene_id))'))}), "
    f"e AS MATERIALIZED ({_ES.format(key='perm, ', hits=_HITS.format(key='perm, ', hits=_DRAW))}), "
    "m AS MATERIALIZED (SELECT set_name, avg(es) FILTER (es > 0) AS up, -avg(es) FILTER (es < 0) AS down FROM e GROUP BY 1), "
    "s AS MATERIALIZED (SELECT o.set_name, o.es, o.es / CASE WHEN o.es >= 0 THEN up ELSE down END AS nes, (SELECT count(*) FILTER (abs(e.es) >= abs(o.es))::DOUBLE / count(*) FROM e WHERE e.set_name = o.set_name AND sign(e.es) = sign(o.es)) AS p FROM o JOIN m USING (set_name)), "
    "x AS MATERIALIZED (SELECT e.es / CASE WHEN e.es >= 0 THEN up ELSE down END AS v FROM e JOIN m USING (set_name)) "
    "SELECT set_name, es, nes, p, least(1, ((SELECT count(*) FILTER (abs(v) >= abs(nes)) FROM x WHERE (v >= 0) = (nes >= 0)) / (SELECT count(*)::DOUBLE FROM x WHERE (v >= 0) = (nes >= 0))) / ((SELECT count(*) FILTER (abs(t.nes) >= abs(s.nes)) FROM s t WHERE (t.nes >= 0) = (s.nes >= 0)) / (SELECT count(*)::DOUBLE FROM s t WHERE (t.nes >= 0) = (s.nes >= 0)))) AS fdr FROM s"
)


@query(f"SELECT set_name, round(es, 5) + 0.0 AS es, round(nes, 5) + 0.0 AS nes, round(p, 6) AS p, round(fdr, 5) AS fdr FROM ({_GSEA})")
def gsea_prerank(s, d):
    t = enrichment.prerank(_ranking(s, d).withColumn("score", F.round("score", 9)), proxy.genes(s, d).select("set_name", "gene_id"))
    return t.select("set_name", (F.round("es", 5) + 0.0).alias("es"), (F.round("nes", 5) + 0.0).alias("nes"), r6("p"), F.round("fdr", 5).alias("fdr"))


def _spot_sets(s):
    return s.range(2, 64).select(F.concat(F.lit("set"), (F.col("id") % 5).cast("string")).alias("set_name"), F.col("id").cast("int").alias("gene_id"))


@query("SELECT obs_id, set_name, round(sum(CASE WHEN own = set_name THEN w / tw ELSE 0 END * (62 - pos + 1)) - sum(CASE WHEN own <> set_name THEN (62 - pos + 1) / (62.0 - size) ELSE 0 END), 6) + 0.0 AS score FROM (SELECT obs_id, 'set' || CAST(gene_id % 5 AS VARCHAR) AS own, row_number() OVER (PARTITION BY obs_id ORDER BY value DESC, gene_id) AS pos, pow(62 - row_number() OVER (PARTITION BY obs_id ORDER BY value DESC, gene_id) + 1, 0.25) AS w FROM vals) JOIN (SELECT obs_id, 'set' || CAST(gene_id % 5 AS VARCHAR) AS set_name, sum(w) AS tw, count(*) AS size FROM (SELECT obs_id, gene_id, pow(62 - row_number() OVER (PARTITION BY obs_id ORDER BY value DESC, gene_id) + 1, 0.25) AS w FROM vals) GROUP BY 1, 2) USING (obs_id) GROUP BY 1, 2")
def ssgsea_scores(s, d):
    return enrichment.ssgsea(proxy.spot_values(s, d), _spot_sets(s)).select("obs_id", "set_name", r6("score"))


@query("SELECT obs_id, set_name, round(avg(score), 6) + 0.0 AS score FROM (SELECT e.src AS obs_id, set_name, score FROM (SELECT src, dst FROM nn UNION ALL SELECT obs_id, obs_id FROM spots) e JOIN (SELECT obs_id AS dst, 'set' || CAST(gene_id % 5 AS VARCHAR) AS set_name, avg(value) AS score FROM vals GROUP BY 1, 2) USING (dst)) GROUP BY 1, 2")
def set_mean_score_smoothed(s, d):
    m = enrichment.mean_score(proxy.spot_values(s, d), _spot_sets(s))
    return enrichment.smoothed(m, neighbors.knn(proxy.spots(s, d), 6)).select("obs_id", "set_name", r6("score"))


@query("SELECT set_name, round(avg(score), 6) + 0.0 AS mean, round(stddev_samp(score), 6) AS sd, round(median(score), 6) + 0.0 AS median, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.75), 6) AS q75 FROM (SELECT obs_id, 'set' || CAST(gene_id % 5 AS VARCHAR) AS set_name, avg(value) AS score FROM vals GROUP BY 1, 2) GROUP BY 1")
def score_summary(s, d):
    t = enrichment.score_summary(enrichment.mean_score(proxy.spot_values(s, d), _spot_sets(s)))
    return t.select("set_name", r6("mean"), r6("sd"), r6("median"), r6("q25"), r6("q75"))


@query("SELECT set_name, count(*) AS n FROM genes GROUP BY 1 HAVING count(*) BETWEEN 8 AND 90")
def set_size_filter(s, d):
    return enrichment.sized_sets(proxy.genes(s, d).select("set_name", "gene_id"), 8, 90).groupBy("set_name").agg(F.count("*").alias("n"))


# --- deconvolution, layers, plots -----------------------------------------------------------------------------------


def _props(s, d):
    c = proxy.counts(s, d).groupBy("obs_id", F.concat(F.lit("ct"), (F.col("gene_id") % 6).cast("string")).alias("cell_type")).agg(F.sum("value").alias("v"))
    t = c.groupBy("obs_id").agg(F.sum("v").alias("t"))
    return c.join(t, "obs_id").select("obs_id", "cell_type", (F.col("v") / F.col("t")).alias("proportion"))


@query("SELECT obs_id, first(cell_type ORDER BY proportion DESC, cell_type) AS cell_type, round(max(proportion), 6) AS proportion FROM props GROUP BY 1")
def dominant_type(s, d):
    return deconvolution.dominant(_props(s, d)).select("obs_id", "cell_type", r6("proportion"))


@query("SELECT obs_id, round(-sum(q * log2(q)) / log2(count(*)), 6) AS entropy FROM (SELECT obs_id, (proportion + 1e-10) / sum(proportion + 1e-10) OVER (PARTITION BY obs_id) AS q FROM props) GROUP BY 1")
def diversity_entropy(s, d):
    return deconvolution.diversity(_props(s, d)).select("obs_id", r6("entropy"))


@query("SELECT cell_type, round(avg(proportion), 6) AS mean, count(*) FILTER (r = 1) AS n_dominant FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY proportion DESC, cell_type) AS r FROM props) GROUP BY 1")
def proportion_summary(s, d):
    return deconvolution.summary(_props(s, d)).select("cell_type", r6("mean"), "n_dominant")


@query()
def nnls_proportions(s, d):
    c = proxy.counts(s, d)
    ref = deconvolution.reference_profiles(c, proxy.cells(s, d).select("obs_id", F.concat(F.lit("t"), F.col("group").cast("string")).alias("cell_type")))
    return deconvolution.proportions(c, ref)


def _spot_counts(s, d):
    """Counts of spots: the positive part of each value in tenths, rounded."""
    return proxy.spot_values(s, d).select("obs_id", "gene_id", F.round(F.greatest(F.lit(0.0), F.col("value")) * 10).alias("value")).where("value > 0")


@query()
def smooth_proportions(s, d):
    """Six types of genes of their own; profiles that are nearly multiples of each other take hundreds of rounds."""
    c = _spot_counts(s, d)
    n = c.select("obs_id").distinct().count()
    ref = c.groupBy(F.concat(F.lit("ct"), (F.col("gene_id") % 6).cast("string")).alias("cell_type"), "gene_id").agg((F.sum("value") / n).alias("value"))
    return deconvolution.smooth_proportions(c, ref, neighbors.knn(proxy.spots(s, d), 6), 0.1, 30, settled=1e-5)


@query()
def factor_proportions(s, d):
    """Suppliers of five groups as the reference, and as the spots."""
    types = proxy.cells(s, d).select("obs_id", F.concat(F.lit("ct"), F.col("group").cast("string")).alias("cell_type"))
    c = proxy.counts(s, d).withColumn("value", F.col("value").cast("double"))
    return factors.factor_proportions(c, c, types, least_genes=30, settled=1e-3)


@query()
def marker_mixture_types(s, d):
    return marker_mixture.assign(_spot_counts(s, d), proxy.types(s, d))


_MOM = "(SELECT src AS obs_id, gene_id, sum(spliced) / 5.0 AS ms, sum(unspliced) / 5.0 AS mu FROM (SELECT a.s_suppkey AS src, (a.s_suppkey + i) % (SELECT count(*) FROM supplier) AS dst FROM supplier a, range(0, 5) t(i)) e JOIN layers ON layers.obs_id = dst GROUP BY 1, 2)"
_VEL = f"(SELECT o.s_suppkey AS obs_id, g.gene_id, coalesce(mu - gamma * ms, 0) AS v, coalesce(ms, 0) AS ms FROM supplier o CROSS JOIN (SELECT gene_id, sum(mu * ms) / sum(ms * ms) AS gamma FROM {_MOM} GROUP BY 1 HAVING sum(ms * ms) > 0) g LEFT JOIN {_MOM} m ON m.obs_id = o.s_suppkey AND m.gene_id = g.gene_id)"


def _ring(s, d):
    n = proxy.cells(s, d).count()
    return proxy.cells(s, d).select(F.col("obs_id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i")).select("src", ((F.col("src") + F.col("i")) % n).alias("dst"))


@query(f"SELECT m.obs_id, gene_id, round(ms, 6) AS ms, round(mu, 6) AS mu, round(mu * ss - us * ms, 3) + 0.0 AS scaled_velocity FROM {_MOM} m JOIN (SELECT gene_id, sum(mu * ms) AS us, sum(ms * ms) AS ss FROM {_MOM} GROUP BY 1 HAVING sum(ms * ms) > 0) USING (gene_id)")
def velocity_moments(s, d):
    """Velocity times the gene's sum of squares, which has few decimals: the quotient has true ties at any number of places."""
    v = dynamics.velocity(dynamics.moments(proxy.layers(s, d), _ring(s, d)))
    return v.select("obs_id", "gene_id", r6("ms"), r6("mu"), (F.round(F.col("velocity") * F.col("ss"), 3) + 0.0).alias("scaled_velocity"))


@query(f"SELECT a.obs_id AS src, b.obs_id AS dst, round(sum(a.v * (b.ms - a.ms)) / sqrt(sum(a.v * a.v) * sum((b.ms - a.ms) * (b.ms - a.ms))), 5) + 0.0 AS cosine FROM {_VEL} a JOIN {_VEL} b ON a.gene_id = b.gene_id JOIN range(1, 5) t(i) ON b.obs_id = (a.obs_id + i) % (SELECT count(*) FROM supplier) GROUP BY 1, 2")
def velocity_graph(s, d):
    e = _ring(s, d)
    m = dynamics.moments(proxy.layers(s, d), e)
    return dynamics.velocity_graph(dynamics.velocity(m), m, e).select("src", "dst", (F.round("cosine", 5) + 0.0).alias("cosine"))


@query(f"SELECT obs_id, round(avg(r), 5) + 0.0 AS confidence FROM (SELECT a.obs_id, b.obs_id AS dst, corr(a.v, b.v) AS r FROM {_VEL} a JOIN {_VEL} b ON a.gene_id = b.gene_id JOIN range(1, 5) t(i) ON b.obs_id = (a.obs_id + i) % (SELECT count(*) FROM supplier) GROUP BY 1, 2) GROUP BY 1")
def velocity_confidence(s, d):
    e = _ring(s, d)
    return dynamics.velocity_confidence(dynamics.velocity(dynamics.moments(proxy.layers(s, d), e)), e).select("obs_id", (F.round("confidence", 5) + 0.0).alias("confidence"))


@query("SELECT grp AS \"group\", round(sum(spliced) / sum(spliced + unspliced), 6) AS spliced, round(sum(unspliced) / sum(spliced + unspliced), 6) AS unspliced FROM layers JOIN cells USING (obs_id) GROUP BY 1")
def splice_proportions(s, d):
    return dynamics.splice_proportions(proxy.layers(s, d), proxy.cells(s, d)).select("group", r6("spliced"), r6("unspliced"))


@query("SELECT grp AS \"group\", gene_id, round(sum(coalesce(value, 0)) / count(*), 6) AS mean, round(count(value) / count(*)::DOUBLE, 6) AS fraction FROM cells CROSS JOIN (SELECT DISTINCT gene_id FROM counts) g LEFT JOIN counts USING (obs_id, gene_id) GROUP BY 1, 2")
def dotplot_data(s, d):
    return plotdata.dotplot(proxy.counts(s, d), proxy.cells(s, d)).select("group", "gene_id", r6("mean"), r6("fraction"))


@query("SELECT gene_id, CAST(place AS INTEGER) AS place, round(avg(value) OVER (PARTITION BY gene_id ORDER BY place ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), 6) + 0.0 AS value FROM (SELECT gene_id, value, row_number() OVER (PARTITION BY gene_id ORDER BY x, obs_id) AS place FROM vals JOIN spots USING (obs_id))")
def ordered_heatmap(s, d):
    return dynamics.ordered_average(proxy.spot_values(s, d), proxy.spots(s, d).select("obs_id", F.col("x").alias("time"))).select("gene_id", "place", r6("value"))


@query("SELECT CAST(l_orderkey % 1000 AS BIGINT) AS obs_id, count(*) FILTER (l_quantity > 0) AS n_genes, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def running_qc(s, d):
    from cellweave.streaming.incremental_qc import running_qc as run

    return run(proxy.table(s, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("obs_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").alias("value")))


@query("SELECT date_trunc('hour', ts) AS start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_qc(s, d):
    from cellweave.streaming.incremental_qc import windowed_qc as run

    e = proxy.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), "value")
    return run(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n", F.round("total", 4).alias("total"))


def _trend_sql(points: str, rounds: int) -> str:
    """Coefficients of the dispersion trend, each round a table over the one before."""
    steps = [f"p AS ({points})"]
    for k in range(rounds):
        weighed = "SELECT x, y, 1 / (y * y) AS w FROM p" if not k else f"SELECT x, y, 1 / (fit * fit) AS w FROM (SELECT x, y, greatest(a1 * x + a0, 1e-8) AS fit FROM p, f{k - 1}) WHERE y / fit > 1e-4 AND y / fit < 15"
        sums = f"SELECT count(*) AS n, sum(w) AS s, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy FROM ({weighed})"
        slope = f"SELECT *, CASE WHEN s * sxx - sx * sx > 1e-12 * s * sxx THEN (s * sxy - sx * sy) / (s * sxx - sx * sx) ELSE 0 END AS b FROM ({sums}) WHERE n > 1"
        steps.append(f"f{k} AS MATERIALIZED (SELECT CASE WHEN b < 0 THEN sy / s WHEN a < 0 THEN 0 ELSE a END AS a0, CASE WHEN b < 0 THEN 0 WHEN a < 0 THEN sxy / sxx ELSE b END AS a1 FROM (SELECT *, sy / s - b * sx / s AS a FROM ({slope})))")
    return f"(WITH {', '.join(steps)} SELECT a0, a1 FROM f{rounds - 1})"


@query("SELECT round(a0, 6) AS a0, round(a1, 6) AS a1 FROM " + _trend_sql("SELECT 1 / mean AS x, (var - mean) / (mean * mean) AS y FROM (SELECT gene_id, s / n AS mean, (q - s * s / n) / (n - 1) AS var FROM (SELECT gene_id, sum(value) AS s, sum(value * value) AS q, (SELECT count(*) FROM cells) AS n FROM counts GROUP BY 1)) WHERE mean > 0 AND (var - mean) / (mean * mean) > 1e-6", 10))
def dispersion_trend(s, d):
    n = proxy.cells(s, d).count()
    m = stats.zero_aware(proxy.counts(s, d), ("gene_id",), F.lit(n), ddof=1)
    points = m.select("mean", ((F.col("var") - F.col("mean")) / (F.col("mean") * F.col("mean"))).alias("dispersion"))
    return dispersion.trend(points).select(F.round("a0", 6).alias("a0"), F.round("a1", 6).alias("a1"))
