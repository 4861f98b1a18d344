"""Queries on spots: graphs, spatial statistics, communication, annotation, profiles along chromosomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import annotation, cnv, communication, delaunay, domains, dynamics, embedding, integration, leiden, neighbors, null_laws, plotdata, preprocess, spatial, spatial_genes, summaries
from cellweave.plans import proxy
from cellweave.plans.proxy import query, r6, sql_bh, sql_normal_p
from cellweave.sources import sinks

K = 6


def _graph(s, d):
    return neighbors.knn(proxy.spots(s, d), K)


def _labels(s, d):
    return proxy.spots(s, d).select("obs_id", F.col("cluster").alias("label"))


def _groups(s, d):
    return proxy.spots(s, d).select("obs_id", F.col("cluster").alias("group"))


@query("SELECT src, dst, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM nn")
def knn_edges(s, d):
    return _graph(s, d).select("src", "dst", r6("d"), "rank")


@query("SELECT a.obs_id AS src, b.obs_id AS dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d FROM spots a JOIN spots b ON a.obs_id <> b.obs_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05 * 0.05")
def radius_edges(s, d):
    return neighbors.radius_edges(proxy.spots(s, d), 0.05).select("src", "dst", r6("d"))


@query("SELECT a.s_suppkey AS src, b.s_suppkey AS dst, CAST(greatest(abs(dr), (abs(dr) + abs(dc)) // 2) AS INTEGER) AS ring FROM (SELECT s_suppkey, s_suppkey // 10 AS r, 2 * (s_suppkey % 10) + (s_suppkey // 10) % 2 AS c FROM supplier) a JOIN (SELECT s_suppkey, s_suppkey // 10 AS r, 2 * (s_suppkey % 10) + (s_suppkey // 10) % 2 AS c FROM supplier) b ON true, LATERAL (SELECT b.r - a.r AS dr, b.c - a.c AS dc) WHERE (dr <> 0 OR dc <> 0) AND greatest(abs(dr), (abs(dr) + abs(dc)) // 2) <= 2")
def grid_ring_edges(s, d):
    spots = proxy.table(s, d, "supplier").select(F.col("s_suppkey").alias("obs_id"), F.expr("s_suppkey div 10").alias("row"), (2 * (F.col("s_suppkey") % 10) + F.expr("s_suppkey div 10") % 2).alias("col"))
    return neighbors.grid_ring_edges(spots, 2)


@query("SELECT a.obs_id AS src, b.obs_id AS dst, round(sqrt(d2), 5) AS d, CAST(rank AS INTEGER) AS rank FROM (SELECT a.obs_id AS aid, b.obs_id AS bid, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2, row_number() OVER (PARTITION BY a.obs_id ORDER BY d2, b.obs_id) AS rank FROM vecs a JOIN vecs b ON a.obs_id <> b.obs_id) q JOIN vecs a ON a.obs_id = aid JOIN vecs b ON b.obs_id = bid WHERE rank <= 5")
def expression_knn(s, d):
    return neighbors.vector_knn(proxy.spot_vectors(s, d), 5).select("src", "dst", F.round("d", 5).alias("d"), "rank")


@query("SELECT src, dst, batch, CAST(rank AS INTEGER) AS rank FROM (SELECT a.obs_id AS src, b.obs_id AS dst, b.batch AS batch, row_number() OVER (PARTITION BY a.obs_id, b.batch ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), b.obs_id) AS rank FROM vecs a JOIN vecs b ON a.obs_id <> b.obs_id) WHERE rank <= 3")
def batch_knn(s, d):
    return integration.batch_balanced_knn(proxy.spot_vectors(s, d), 3).select("src", "dst", "batch", "rank")


@query("SELECT src AS a, dst AS b FROM (SELECT a.obs_id AS src, b.obs_id AS dst, a.batch AS own, b.batch AS batch, row_number() OVER (PARTITION BY a.obs_id, b.batch ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), b.obs_id) AS rank FROM vecs a JOIN vecs b ON a.obs_id <> b.obs_id) e WHERE rank <= 5 AND own <> batch AND src < dst AND EXISTS (SELECT 1 FROM (SELECT a.obs_id AS src2, b.obs_id AS dst2, row_number() OVER (PARTITION BY a.obs_id, b.batch ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), b.obs_id) AS rank2 FROM vecs a JOIN vecs b ON a.obs_id <> b.obs_id) f WHERE rank2 <= 5 AND src2 = e.dst AND dst2 = e.src)")
def mutual_nn(s, d):
    return integration.mutual_pairs(proxy.spot_vectors(s, d), 5)


@query("SELECT src, dst, round(sum(w), 6) AS w FROM (SELECT src, dst, 0.7 / 6 AS w FROM (SELECT a.obs_id AS src, b.obs_id AS dst, row_number() OVER (PARTITION BY a.obs_id ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), b.obs_id) AS rank FROM vecs a JOIN vecs b ON a.obs_id <> b.obs_id) WHERE rank <= 6 UNION ALL SELECT src, dst, 0.3 / 6 FROM nn) GROUP BY 1, 2")
def combined_graph(s, d):
    e = neighbors.row_standardised(neighbors.vector_knn(proxy.spot_vectors(s, d), K).select("src", "dst"))
    return neighbors.combined(e, neighbors.row_standardised(_graph(s, d)), 0.3).select("src", "dst", r6("w"))


@query(f"SELECT gene_id, round(i, 6) AS moran_i, round(v, 6) AS variance, round(z, 5) AS z, round({sql_normal_p('z')}, 6) AS p FROM (SELECT *, (i - e) / sqrt(v) AS z FROM (SELECT gene_id, n / s0 * num / zz AS i, -1.0 / (n - 1) AS e, (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1.0 / ((n - 1) * (n - 1)) AS v FROM (SELECT gene_id, sum(a.z * b.z) AS num FROM nn JOIN zs a ON a.obs_id = src JOIN zs b USING (gene_id) WHERE b.obs_id = dst GROUP BY 1) JOIN (SELECT gene_id, count(*)::DOUBLE AS n, sum(z * z) AS zz FROM zs GROUP BY 1) USING (gene_id), moments))")
def morans_i(s, d):
    return spatial.morans_i(_graph(s, d), proxy.spot_values(s, d)).select("gene_id", r6("moran_i"), r6("variance"), F.round("z", 5).alias("z"), r6("p"))


_GEARY = "SELECT gene_id, (n - 1) / (2 * s0) * num / zz AS c, ((2 * s1 + s2) * (n - 1) - 4 * s0 * s0) / (2 * (n + 1) * s0 * s0) AS v FROM (SELECT gene_id, sum((a.z - b.z) * (a.z - b.z)) AS num FROM nn JOIN zs a ON a.obs_id = src JOIN zs b USING (gene_id) WHERE b.obs_id = dst GROUP BY 1) JOIN (SELECT gene_id, count(*)::DOUBLE AS n, sum(z * z) AS zz FROM zs GROUP BY 1) USING (gene_id), moments"


@query(f"SELECT gene_id, round(c, 6) AS geary_c, round(v, 6) AS variance, round(z, 5) AS z, round({sql_normal_p('z')}, 6) AS p FROM (SELECT *, (c - 1) / sqrt(v) AS z FROM ({_GEARY}))")
def gearys_c(s, d):
    return spatial.gearys_c(_graph(s, d), proxy.spot_values(s, d)).select("gene_id", r6("geary_c"), r6("variance"), F.round("z", 5).alias("z"), r6("p"))


_LISA = "SELECT obs_id, gene_id, z * lag / m2 AS local_i, CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS quadrant FROM zs JOIN lag USING (obs_id, gene_id) JOIN (SELECT gene_id, sum(z * z) / (count(*) - 1) AS m2 FROM zs GROUP BY 1) USING (gene_id)"


@query(f"SELECT obs_id, gene_id, round(local_i, 5) + 0.0 AS local_i, quadrant FROM ({_LISA})")
def local_morans(s, d):
    return spatial.local_morans(_graph(s, d), proxy.spot_values(s, d)).select("obs_id", "gene_id", (F.round("local_i", 5) + 0.0).alias("local_i"), "quadrant")


@query(f"SELECT gene_id, quadrant, count(*) AS n FROM ({_LISA}) GROUP BY 1, 2")
def lisa_quadrants(s, d):
    return spatial.local_morans(_graph(s, d), proxy.spot_values(s, d)).groupBy("gene_id", "quadrant").agg(F.count("*").alias("n"))


def _perms(p: int, ids: str) -> str:
    return f"(SELECT a.perm, a.obs_id, b.obs_id AS partner FROM (SELECT perm, obs_id, row_number() OVER (PARTITION BY perm ORDER BY obs_id) AS place FROM {ids}, range(1, {p + 1}) t(perm)) a JOIN (SELECT perm, obs_id, row_number() OVER (PARTITION BY perm ORDER BY md5('42:' || CAST(perm AS VARCHAR) || ':' || CAST(obs_id AS VARCHAR)), obs_id) AS place FROM {ids}, range(1, {p + 1}) t(perm)) b USING (perm, place))"


@query(f"SELECT obs_id, gene_id, round((least(above, 19 - above) + 1.0) / 20, 6) AS p_sim FROM (SELECT obs_id, gene_id, count(*) FILTER (plag >= lag) AS above FROM (SELECT perm, src AS obs_id, gene_id, avg(z) AS plag FROM nn JOIN {_perms(19, 'spots')} p ON p.obs_id = dst JOIN (SELECT obs_id AS partner, gene_id, z FROM zs) USING (partner) GROUP BY 1, 2, 3) JOIN lag USING (obs_id, gene_id) GROUP BY 1, 2)")
def local_morans_perm_p(s, d):
    return spatial.local_morans_p(_graph(s, d), proxy.spot_values(s, d), 19).select("obs_id", "gene_id", r6("p_sim"))


_GI = "SELECT src AS obs_id, gene_id, (avg(value) - any_value(m)) / (any_value(sd) * sqrt((any_value(n) / count(*) - 1) / (any_value(n) - 1))) AS g FROM (SELECT src, dst FROM nn UNION ALL SELECT obs_id, obs_id FROM spots) e JOIN vals ON vals.obs_id = dst JOIN (SELECT gene_id, count(*)::DOUBLE AS n, avg(value) AS m, stddev_pop(value) AS sd FROM vals GROUP BY 1) USING (gene_id) GROUP BY 1, 2"


@query(f"SELECT obs_id, gene_id, round(g, 5) + 0.0 AS g_z, CASE WHEN g > 1.959963984540054 THEN 'hot' WHEN g < -1.959963984540054 THEN 'cold' ELSE 'ns' END AS spot FROM ({_GI})")
def getis_ord_gi(s, d):
    return spatial.getis_ord(_graph(s, d), proxy.spot_values(s, d)).select("obs_id", "gene_id", (F.round("g_z", 5) + 0.0).alias("g_z"), "spot")


_GI_P = f"SELECT *, {sql_normal_p('g')} AS p FROM ({_GI})"
_GI_Q = f"SELECT *, {sql_bh('p', 'gene_id', 'obs_id')[1]} AS q FROM (SELECT *, {sql_bh('p', 'gene_id', 'obs_id')[0]} FROM ({_GI_P}))"


@query(f"SELECT obs_id, gene_id, round(p, 5) AS p, round(q, 5) AS q, CASE WHEN q < 0.05 AND g > 0 THEN 'hot' WHEN q < 0.05 AND g < 0 THEN 'cold' ELSE 'ns' END AS spot FROM ({_GI_Q})")
def getis_ord_bh(s, d):
    return spatial.getis_ord(_graph(s, d), proxy.spot_values(s, d), correction="bh").select("obs_id", "gene_id", F.round("p", 5).alias("p"), F.round("q", 5).alias("q"), "spot")


@query(f"SELECT gene_id, round(avg(g), 6) + 0.0 AS mean_z, round(stddev_pop(g), 6) AS sd_z, count(*) FILTER (g > 3.3499595 AND p * 62 < 0.05) AS n_hot, count(*) FILTER (g < -3.3499595 AND p * 62 < 0.05) AS n_cold, count(*) FILTER (p * 62 < 0.05) AS n_significant FROM ({_GI_P}) GROUP BY 1")
def getis_ord_summary(s, d):
    t = spatial.getis_summary(spatial.getis_ord(_graph(s, d), proxy.spot_values(s, d), correction="bonferroni"))
    return t.select("gene_id", r6("mean_z"), r6("sd_z"), "n_hot", "n_cold", "n_significant")


@query("SELECT ligand AS gene_x, receptor AS gene_y, round(num / sqrt(xx * yy), 6) + 0.0 AS moran_xy FROM (SELECT ligand, receptor, sum(z * lag) AS num FROM lr JOIN zs ON zs.gene_id = ligand JOIN lag ON lag.obs_id = zs.obs_id AND lag.gene_id = receptor GROUP BY 1, 2) JOIN (SELECT gene_id AS ligand, sum(z * z) AS xx FROM zs GROUP BY 1) USING (ligand) JOIN (SELECT gene_id AS receptor, sum(z * z) AS yy FROM zs GROUP BY 1) USING (receptor)")
def bivariate_moran(s, d):
    p = proxy.pairs(s, d).select(F.col("ligand").alias("gene_x"), F.col("receptor").alias("gene_y"))
    return spatial.bivariate_moran(_graph(s, d), proxy.spot_values(s, d), p).select("gene_x", "gene_y", r6("moran_xy"))


@query("SELECT sum(a * b) / 2.0 AS bb, sum((1 - a) * (1 - b)) / 2.0 AS ww, sum((a - b) * (a - b)) / 2.0 AS bw, count(*) / 2.0 AS j FROM (SELECT (a.cluster % 2)::DOUBLE AS a, (b.cluster % 2)::DOUBLE AS b FROM nn JOIN spots a ON a.obs_id = src JOIN spots b ON b.obs_id = dst)")
def join_count(s, d):
    return spatial.join_count(_graph(s, d), proxy.spots(s, d).select("obs_id", (F.col("cluster") % 2).alias("label")))


@query("SELECT s.obs_id, s.cluster AS label, count(*) FILTER (o.cluster = s.cluster)::DOUBLE AS ljc FROM spots s LEFT JOIN nn ON src = s.obs_id LEFT JOIN spots o ON o.obs_id = dst GROUP BY 1, 2")
def local_join_count(s, d):
    return spatial.local_join_count(_graph(s, d), _labels(s, d))


@query("SELECT a.cluster AS label_a, b.cluster AS label_b, count(*) AS n FROM nn JOIN spots a ON a.obs_id = src JOIN spots b ON b.obs_id = dst GROUP BY 1, 2")
def nhood_counts(s, d):
    return spatial.neighbourhood_counts(_graph(s, d), _labels(s, d))


@query(f"SELECT label_a, label_b, coalesce(n, 0) AS n, round((coalesce(n, 0) - m) / sqrt(greatest(sq - m * m, 0)), 4) + 0.0 AS zscore FROM (SELECT label_a, label_b, sum(c) / 30.0 AS m, sum(c * c) / 30.0 AS sq FROM (SELECT perm, a.cluster AS label_a, b.cluster AS label_b, count(*) AS c FROM nn JOIN {_perms(30, 'spots')} p ON p.obs_id = src JOIN spots a ON a.obs_id = p.partner JOIN {_perms(30, 'spots')} q USING (perm) JOIN spots b ON b.obs_id = q.partner WHERE q.obs_id = dst GROUP BY 1, 2, 3) GROUP BY 1, 2) FULL JOIN (SELECT a.cluster AS label_a, b.cluster AS label_b, count(*) AS n FROM nn JOIN spots a ON a.obs_id = src JOIN spots b ON b.obs_id = dst GROUP BY 1, 2) USING (label_a, label_b)")
def nhood_zscore_perm(s, d):
    return spatial.neighbourhood_enrichment(_graph(s, d), _labels(s, d), 30).select("label_a", "label_b", "n", (F.round("zscore", 4) + 0.0).alias("zscore"))


_CO = "SELECT label_a, label_b, bin, (c / a_all) / (b_all / every) AS ratio FROM (SELECT *, sum(c) OVER (PARTITION BY label_a, bin) AS a_all, sum(c) OVER (PARTITION BY label_b, bin) AS b_all, sum(c) OVER (PARTITION BY bin) AS every FROM (SELECT label_a, label_b, bin, sum(n) OVER (PARTITION BY label_a, label_b ORDER BY bin) AS c FROM (SELECT g.label_a, g.label_b, g.bin, coalesce(n, 0)::DOUBLE AS n FROM (SELECT DISTINCT a.cluster AS label_a, b.cluster AS label_b, CAST(bin AS INTEGER) AS bin FROM spots a, spots b, range(1, 51) t(bin)) g LEFT JOIN (SELECT la AS label_a, lb AS label_b, CAST(least(50, floor(d / (top / 50)) + 1) AS INTEGER) AS bin, count(*) AS n FROM (SELECT a.cluster AS la, b.cluster AS lb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, top FROM spots a JOIN spots b ON a.obs_id <> b.obs_id, (SELECT sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))) / 2 AS top FROM spots)) WHERE d <= top GROUP BY 1, 2, 3) h USING (label_a, label_b, bin)))) WHERE c > 0"


@query(f"SELECT label_a, label_b, bin, round(ratio, 6) AS ratio FROM ({_CO})")
def co_occurrence(s, d):
    return spatial.co_occurrence(proxy.spots(s, d), _labels(s, d)).select("label_a", "label_b", "bin", r6("ratio"))


def _ripley_sql(points: str, by: str, steps: int) -> str:
    """L of point sets in SQL; ``points`` has the columns ``by``, obs_id, x, y."""
    keys = [k.strip() for k in by.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    g, h = ", ".join(f"g.{k}" for k in keys), ", ".join(f"a.{k}" for k in keys)
    return f"SELECT {by}, step, sqrt(area * sum(n) OVER (PARTITION BY {by} ORDER BY step) / (pi() * size * (size - 1))) AS l FROM (SELECT {g}, g.step, size, area, coalesce(n, 0)::DOUBLE AS n FROM (SELECT {by}, count(*)::DOUBLE AS size, CAST(step AS INTEGER) AS step FROM {points}, range(1, {steps + 1}) t(step) GROUP BY {by}, step) g LEFT JOIN (SELECT {by}, CAST(ceil(d / (top / {steps})) AS INTEGER) AS step, count(*) AS n FROM (SELECT {h}, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, top FROM {points} a JOIN {points} b ON a.obs_id <> b.obs_id AND {same}, (SELECT greatest(max(x) - min(x), max(y) - min(y)) / 4 AS top FROM spots)) WHERE d <= top GROUP BY ALL) h USING ({by}, step), (SELECT (max(x) - min(x)) * (max(y) - min(y)) AS area FROM spots))"


_LABELLED = "(SELECT cluster AS label, obs_id, x, y FROM spots)"


@query(f"SELECT label, step, round(l, 6) AS l FROM ({_ripley_sql(_LABELLED, 'label', 50)})")
def ripley_l_observed(s, d):
    return spatial.ripley_l(proxy.spots(s, d), _labels(s, d)).select("label", "step", r6("l"))


_DRAWN = "(SELECT label, CAST(sim AS INTEGER) AS sim, i AS obs_id, x0 + (x1 - x0) * (CAST('0x' || substr(md5('42:x:' || sim || ':' || label || ':' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS x, y0 + (y1 - y0) * (CAST('0x' || substr(md5('42:y:' || sim || ':' || label || ':' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS y FROM (SELECT cluster AS label, unnest(range(1, count(*) + 1)) AS i FROM spots GROUP BY 1), range(1, 6) t(sim), (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM spots))"


@query(f"SELECT label, step, round(o.l, 6) AS l, round(min(s.l), 6) AS low, round(max(s.l), 6) AS high, round((count(*) FILTER (s.l >= o.l) + 1.0) / 6, 6) AS p FROM ({_ripley_sql(_LABELLED, 'label', 20)}) o JOIN ({_ripley_sql(_DRAWN, 'label, sim', 20)}) s USING (label, step) GROUP BY label, step, o.l")
def ripley_envelope(s, d):
    t = spatial.ripley_envelopes(proxy.spots(s, d), _labels(s, d), 20, 5)
    return t.select("label", "step", r6("l"), r6("low"), r6("high"), r6("p"))


@query("SELECT i AS obs_id, count(*) AS degree FROM (SELECT a AS i FROM und UNION ALL SELECT b FROM und) GROUP BY 1")
def degree_centrality(s, d):
    return neighbors.degree(_graph(s, d))


_TRI = "SELECT d.obs_id, degree, coalesce(t, 0) AS triangles, CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END AS clustering FROM (SELECT i AS obs_id, count(*) AS degree FROM (SELECT a AS i FROM und UNION ALL SELECT b FROM und) GROUP BY 1) d LEFT JOIN (SELECT i AS obs_id, count(*) AS t FROM (SELECT unnest([x.a, x.b, y.b]) AS i FROM und x JOIN und y ON y.a = x.b JOIN und z ON z.a = x.a AND z.b = y.b) GROUP BY 1) t ON t.obs_id = d.obs_id"


@query(f"SELECT obs_id, degree, triangles, round(clustering, 6) AS clustering FROM ({_TRI})")
def avg_clustering(s, d):
    return neighbors.clustering(_graph(s, d)).select("obs_id", "degree", "triangles", r6("clustering"))


@query(f"SELECT (SELECT count(*) FROM spots) AS n_nodes, CAST(sum(degree) // 2 AS BIGINT) AS n_edges, round(avg(clustering), 6) AS avg_clustering, round(avg(degree), 6) AS degree_mean, round(stddev_pop(degree), 6) AS degree_sd, round(sum(degree) / (count(*) * (count(*) - 1.0)), 6) AS density FROM ({_TRI})")
def network_density(s, d):
    p = spatial.network_properties(_graph(s, d), proxy.spots(s, d), paths=False)
    return p.select("n_nodes", "n_edges", r6("avg_clustering"), r6("degree_mean"), r6("degree_sd"), r6("density"))


_BOTH = "SELECT a AS i, b AS j FROM und UNION ALL SELECT b, a FROM und"


@query(f"SELECT obs_id, min(root) AS component FROM (WITH RECURSIVE reach AS (SELECT obs_id, obs_id AS root FROM spots UNION SELECT j, root FROM reach JOIN ({_BOTH}) ON i = obs_id) SELECT * FROM reach) GROUP BY 1")
def connected_components(s, d):
    return neighbors.connected(_graph(s, d), proxy.spots(s, d))


def _paths_sql(levels: int = 40) -> str:
    """(s, t, hops, paths) of all reachable ordered pairs, level by level, with the number of shortest paths."""
    parts = [f"two AS MATERIALIZED ({_BOTH})", "l0 AS MATERIALIZED (SELECT obs_id AS s, obs_id AS t, 0 AS hops, 1.0::DOUBLE AS paths FROM spots)", "seen0 AS MATERIALIZED (SELECT s, t FROM l0)"]
    for k in range(1, levels):
        parts.append(f"l{k} AS MATERIALIZED (SELECT s, j AS t, {k} AS hops, sum(paths) AS paths FROM l{k - 1} JOIN two ON i = t WHERE NOT EXISTS (SELECT 1 FROM seen{k - 1} z WHERE z.s = l{k - 1}.s AND z.t = two.j) GROUP BY 1, 2)")
        parts.append(f"seen{k} AS MATERIALIZED (SELECT * FROM seen{k - 1} UNION ALL SELECT s, t FROM l{k})")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, levels))


@query(f"SELECT obs_id, round(coalesce(k / dist * k / (n - 1), 0), 6) AS closeness FROM spots, (SELECT count(*)::DOUBLE AS n FROM spots) LEFT JOIN (SELECT s, count(*)::DOUBLE AS k, sum(hops)::DOUBLE AS dist FROM ({_paths_sql()}) GROUP BY 1) ON s = obs_id")
def node_closeness(s, d):
    return spatial.closeness(_graph(s, d), proxy.spots(s, d)).select("obs_id", r6("closeness"))


@query(f"SELECT label, round(coalesce((n - size) / dist, 0), 6) AS closeness FROM (SELECT cluster AS label, count(*)::DOUBLE AS size, (SELECT count(*)::DOUBLE FROM spots) AS n FROM spots GROUP BY 1) LEFT JOIN (SELECT label, sum(h) AS dist FROM (SELECT b.cluster AS label, s, min(hops)::DOUBLE AS h FROM ({_paths_sql()}) JOIN spots a ON a.obs_id = s JOIN spots b ON b.obs_id = t WHERE NOT EXISTS (SELECT 1 FROM spots c WHERE c.obs_id = s AND c.cluster = b.cluster) GROUP BY 1, 2) GROUP BY 1) USING (label)")
def group_closeness(s, d):
    return domains.group_closeness(_graph(s, d), _labels(s, d)).select("label", r6("closeness"))


@query(f"SELECT components, components = 1 AS connected, round(largest / n_nodes, 6) AS largest_share, CASE WHEN components = 1 THEN diameter END AS diameter, CASE WHEN components = 1 THEN radius END AS radius FROM (SELECT count(*) AS components, max(size)::DOUBLE AS largest FROM (SELECT root, count(*) AS size FROM (SELECT obs_id, least(obs_id, coalesce(min(t), obs_id)) AS root FROM spots LEFT JOIN ({_paths_sql()}) ON s = obs_id GROUP BY 1) GROUP BY 1)), (SELECT count(*)::DOUBLE AS n_nodes FROM spots), (SELECT max(far) AS diameter, min(far) AS radius FROM (SELECT s, max(hops) AS far FROM ({_paths_sql()}) GROUP BY 1))")
def network_paths(s, d):
    return spatial.network_properties(_graph(s, d), proxy.spots(s, d)).select("components", "connected", r6("largest_share"), "diameter", "radius")


@query("SELECT obs_id, cluster AS label, CASE WHEN 1.0 - same / total >= 0.5 THEN top ELSE cluster END AS refined FROM (SELECT obs_id, cluster, total, coalesce(max(n) FILTER (other = cluster), 0) AS same, first(other ORDER BY n DESC, met) AS top FROM (SELECT s.obs_id, s.cluster, o.cluster AS other, count(*)::DOUBLE AS n, min(rank) AS met, sum(count(*)) OVER (PARTITION BY s.obs_id) AS total FROM (SELECT a.obs_id AS src, b.obs_id AS dst, row_number() OVER (PARTITION BY a.obs_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.obs_id) AS rank FROM spots a, spots b) e JOIN spots s ON s.obs_id = src JOIN spots o ON o.obs_id = dst WHERE rank <= 10 GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)")
def refine_domains(s, d):
    return spatial.refine_labels(neighbors.knn(proxy.spots(s, d), 10, include_self=True), _labels(s, d))


@query("SELECT obs_id, gene_id, round(value, 6) + 0.0 AS value FROM scaled")
def scale_clip(s, d):
    return preprocess.scale(proxy.spot_values(s, d)).select("obs_id", "gene_id", r6("value"))


@query("SELECT source, target, ligand, receptor, round(score, 6) + 0.0 AS score FROM lrs")
def lr_mean_scores(s, d):
    return communication.pair_scores(proxy.spot_values(s, d), _groups(s, d), proxy.pairs(s, d)).select("source", "target", "ligand", "receptor", r6("score"))


@query(f"SELECT source, target, ligand, receptor, count(*) FILTER ((coalesce(l.mean, 0) + coalesce(r.mean, 0)) / 2 >= score - 1e-12) / 20.0 AS p FROM lrs JOIN range(1, 21) t(perm) ON true LEFT JOIN pm l ON l.perm = t.perm AND l.grp = source AND l.gene_id = ligand LEFT JOIN pm r ON r.perm = t.perm AND r.grp = target AND r.gene_id = receptor GROUP BY 1, 2, 3, 4".replace("pm ", f"(SELECT perm, s.cluster AS grp, gene_id, avg(value) AS mean FROM {_perms(20, 'spots')} p JOIN spots s ON s.obs_id = p.partner JOIN vals ON vals.obs_id = p.obs_id GROUP BY 1, 2, 3) "))
def lr_perm_p(s, d):
    return communication.pair_p_values(proxy.spot_values(s, d), _groups(s, d), proxy.pairs(s, d), 20).select("source", "target", "ligand", "receptor", "p")


#: The law of the median (place ceil(n / 2)) of a group drawn without replacement: a hypergeometric tail at every value, then the
#: sum over one side's values of mass times the other side's tail.
_MEDIAN = """
SELECT * FROM (
WITH total AS (SELECT count(*)::DOUBLE AS total FROM spots),
sizes AS (SELECT cluster AS grp, count(*)::DOUBLE AS n, greatest(1, ceil(count(*) * 0.5 - 1e-9)) AS k FROM spots GROUP BY 1),
step AS (SELECT gene_id, (greatest(max(value), 0) - least(min(value), 0)) / 65536 AS step FROM vals GROUP BY 1),
place AS MATERIALIZED (SELECT obs_id, gene_id, value, avg(value) OVER (PARTITION BY gene_id, floor(value / step), value = 0) AS v FROM vals JOIN step USING (gene_id)),
atoms AS (SELECT gene_id, v, c, sum(c) OVER (PARTITION BY gene_id ORDER BY v) - c AS below FROM (SELECT gene_id, v, count(*)::DOUBLE AS c FROM place GROUP BY 1, 2)),
tails AS MATERIALIZED (SELECT grp, gene_id, v, CASE WHEN below = 0 THEN 1 ELSE coalesce(list_sum(list_transform(range(CAST(greatest(0, n - total + below) AS BIGINT), CAST(least(k - 1, below) AS BIGINT) + 1), lambda j: exp(lgamma(below + 1) - lgamma(j + 1) - lgamma(below - j + 1) + lgamma(total - below + 1) - lgamma(n - j + 1) - lgamma(total - below - n + j + 1) - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1)))), 0) END AS tail FROM atoms, sizes, total),
laws AS MATERIALIZED (SELECT *, tail - lead(tail, 1, 0) OVER (PARTITION BY grp, gene_id ORDER BY v) AS mass FROM tails),
seen AS MATERIALIZED (SELECT grp, gene_id, v AS observed FROM (SELECT cluster AS grp, gene_id, v, k, row_number() OVER (PARTITION BY cluster, gene_id ORDER BY v) AS r, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END) OVER (PARTITION BY cluster, gene_id) AS fraction FROM place JOIN spots USING (obs_id) JOIN sizes ON grp = cluster) WHERE r = k AND fraction >= 0.1),
scores AS (SELECT l.grp AS source, r.grp AS target, ligand, receptor, (l.observed + r.observed) / 2 AS score FROM lr JOIN seen l ON l.gene_id = ligand JOIN seen r ON r.gene_id = receptor),
terms AS (SELECT source, target, ligand, receptor, score, mass, 2 * score - 1e-9 * (abs(score) + 1e-3) - v AS x FROM scores JOIN laws ON grp = source AND gene_id = ligand WHERE mass > 1e-15)
SELECT source, target, ligand, receptor, round(score, 6) + 0.0 AS score, round(least(1, sum(mass * coalesce(tail, 0))), 6) AS p FROM terms t ASOF LEFT JOIN tails r ON r.grp = t.target AND r.gene_id = t.receptor AND t.x <= r.v GROUP BY source, target, ligand, receptor, score)"""


@query(_MEDIAN.strip())
def lr_analytic_median(s, d):
    t = null_laws.analytic_p_values(proxy.spot_values(s, d), _groups(s, d), proxy.pairs(s, d), summary="median")
    return t.select("source", "target", "ligand", "receptor", r6("score"), r6("p"))


@query()
def lr_analytic_combined(s, d):
    """Four summaries and two scores: means by characteristic functions, quantiles by hypergeometric tails."""
    return null_laws.combined_p_values(proxy.spot_values(s, d), _groups(s, d), proxy.pairs(s, d))


@query("SELECT dense_rank() OVER (ORDER BY signature) AS environment, signature, grp AS \"group\" FROM (SELECT DISTINCT list_aggregate(gs, 'string_agg', '|') AS signature, unnest(gs) AS grp FROM (SELECT list_sort(list(DISTINCT CAST(o.cluster AS VARCHAR))) AS gs FROM (SELECT 2 * median(d) AS r FROM nn WHERE rank = 5) q CROSS JOIN spots a JOIN spots o ON (a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y) <= r * r GROUP BY a.obs_id HAVING count(DISTINCT o.cluster) >= 2))")
def microenvironments(s, d):
    return communication.microenvironments(proxy.spots(s, d), _groups(s, d)).withColumn("environment", F.col("environment").cast("long"))


@query("SELECT source, target, ligand, receptor, round(score, 6) AS score FROM lrs WHERE source = target AND score > 0")
def autocrine(s, d):
    return communication.autocrine(communication.pair_scores(proxy.spot_values(s, d), _groups(s, d), proxy.pairs(s, d))).select("source", "target", "ligand", "receptor", r6("score"))


@query("SELECT source, target, ligand, receptor, round(0.5 - atan(avg(tan((0.5 - p) * pi()))) / pi(), 6) AS p FROM (SELECT source, target, ligand, receptor, unnest([1 / (2 + exp(score * 10)), 1 / (3 + exp(score * 5))]) AS p FROM lrs) GROUP BY 1, 2, 3, 4")
def cauchy_combination(s, d):
    sc = communication.pair_scores(proxy.spot_values(s, d), _groups(s, d), proxy.pairs(s, d))
    t = sc.select("source", "target", "ligand", "receptor", F.explode(F.array(1 / (2 + F.exp(F.col("score") * 10)), 1 / (3 + F.exp(F.col("score") * 5)))).alias("p"))
    return communication.combined_p(t).select("source", "target", "ligand", "receptor", r6("p"))


@query("SELECT source, target, round(sum(top - score + 1), 6) AS weight FROM lrs, (SELECT max(score) AS top FROM lrs) GROUP BY 1, 2")
def ccc_circle(s, d):
    return communication.circle_weights(communication.pair_scores(proxy.spot_values(s, d), _groups(s, d), proxy.pairs(s, d))).select("source", "target", r6("weight"))


@query("SELECT CAST(ligand AS VARCHAR) || '_' || CAST(receptor AS VARCHAR) AS pair, CAST(source AS VARCHAR) || '->' || CAST(target AS VARCHAR) AS cell_pair, round(avg(score), 6) + 0.0 AS score FROM lrs GROUP BY 1, 2")
def ccc_tile(s, d):
    return communication.tile(communication.pair_scores(proxy.spot_values(s, d), _groups(s, d), proxy.pairs(s, d))).select("pair", "cell_pair", r6("score"))


@query("SELECT r.obs_id, ligand, receptor, round(v.value * r.near, 6) + 0.0 AS local FROM (SELECT src AS obs_id, gene_id - 1 AS below, gene_id, sum(value) / 6 AS near FROM nn JOIN vals ON vals.obs_id = dst GROUP BY ALL) r JOIN lr ON receptor = r.gene_id AND ligand = r.below JOIN vals v ON v.obs_id = r.obs_id AND v.gene_id = r.below")
def local_lr_products(s, d):
    return communication.local_products(proxy.spot_values(s, d), _graph(s, d), proxy.pairs(s, d)).select("obs_id", "ligand", "receptor", r6("local"))


@query("SELECT obs_id, s.cell_type, round(coalesce(sp / sqrt(np), 0) - coalesce(sn / sqrt(nullif(nn_, 0)), 0), 6) + 0.0 AS score FROM (SELECT obs_id, cell_type, sum(CASE WHEN direction > 0 THEN value * weight ELSE 0 END) AS sp, sum(CASE WHEN direction < 0 THEN value ELSE 0 END) AS sn FROM scaled JOIN (SELECT m.cell_type, m.gene_id, m.direction, coalesce(weight, 1) AS weight FROM markers m LEFT JOIN (SELECT gene_id, CASE WHEN max(f) OVER () > min(f) OVER () THEN 1.0 - (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) ELSE 1 END AS weight FROM (SELECT gene_id, count(DISTINCT cell_type)::DOUBLE AS f FROM markers WHERE direction > 0 GROUP BY 1)) USING (gene_id)) USING (gene_id) GROUP BY 1, 2) s JOIN (SELECT cell_type, count(*) FILTER (direction > 0)::DOUBLE AS np, count(*) FILTER (direction < 0)::DOUBLE AS nn_ FROM markers GROUP BY 1) USING (cell_type)")
def sctype_scores(s, d):
    return annotation.marker_scores(preprocess.scale(proxy.spot_values(s, d)), proxy.types(s, d)).select("obs_id", "cell_type", r6("score"))


def _profile(s, d):
    g = s.range(2, 64).select(F.col("id").cast("int").alias("gene_id"), F.when(F.col("id") < 40, "chr1").otherwise("chr2").alias("chromosome"), F.col("id").alias("pos"))
    return cnv.infer(proxy.spot_values(s, d), g, proxy.spots(s, d).where("obs_id % 5 = 0"), window=30, step=10)


@query("SELECT obs_id, chromosome, bin, round(cnv, 6) + 0.0 AS cnv FROM cnv")
def cnv_running_mean(s, d):
    return _profile(s, d).select("obs_id", "chromosome", "bin", r6("cnv"))


@query("SELECT obs_id, round(avg(abs(cnv)), 6) AS score FROM cnv GROUP BY 1")
def cnv_cell_score(s, d):
    return cnv.cell_scores(_profile(s, d)).select("obs_id", r6("score"))


@query("SELECT cluster AS \"group\", chromosome, bin, round(avg(cnv), 6) + 0.0 AS cnv FROM cnv JOIN spots USING (obs_id) GROUP BY 1, 2, 3")
def cnv_by_group(s, d):
    return cnv.by_group(_profile(s, d), _groups(s, d)).select("group", "chromosome", "bin", r6("cnv"))


@query("SELECT obs_id, cluster % 3 AS batch, round((x - mx) / sx, 6) + 0.0 AS x, round((y - my) / sy, 6) + 0.0 AS y FROM spots, (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM spots WHERE cluster % 3 = 0)")
def align_spatial(s, d):
    c = proxy.spots(s, d).withColumn("batch", F.col("cluster") % 3)
    return integration.align(c, 0).select("obs_id", "batch", r6("x"), r6("y"))


@query("SELECT CASE WHEN obs_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch, obs_id, gene_id, round(value, 6) + 0.0 AS value FROM vals WHERE (obs_id % 2 = 0 AND gene_id < 40) OR (obs_id % 2 = 1 AND gene_id >= 20)")
def outer_concat(s, d):
    v = proxy.spot_values(s, d).select("obs_id", "gene_id", r6("value"))
    return integration.concatenate([v.where("obs_id % 2 = 0 and gene_id < 40"), v.where("obs_id % 2 = 1 and gene_id >= 20")], ["even", "odd"]).select("batch", "obs_id", "gene_id", "value")


@query("SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, round(corr(a.value, b.value), 6) + 0.0 AS r FROM vals a JOIN vals b ON a.obs_id = b.obs_id AND a.gene_id < b.gene_id GROUP BY 1, 2")
def gene_correlation(s, d):
    return plotdata.correlations(proxy.spot_values(s, d)).select("gene_a", "gene_b", r6("r"))


@query("SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, round(corr(a.r, b.r), 6) + 0.0 AS r FROM (SELECT obs_id, gene_id, rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0 AS r FROM vals) a JOIN (SELECT obs_id, gene_id, rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0 AS r FROM vals) b ON a.obs_id = b.obs_id AND a.gene_id < b.gene_id GROUP BY 1, 2")
def spearman_corr(s, d):
    return plotdata.correlations(proxy.spot_values(s, d), "spearman").select("gene_a", "gene_b", r6("r"))


@query("SELECT ligand, receptor, round(corr(a.value, b.value), 6) + 0.0 AS r, round(regr_slope(b.value, a.value), 6) + 0.0 AS slope, round(regr_intercept(b.value, a.value), 6) + 0.0 AS intercept FROM lr JOIN vals a ON a.gene_id = ligand JOIN vals b ON b.gene_id = receptor AND a.obs_id = b.obs_id GROUP BY 1, 2")
def lr_pair_regression(s, d):
    return plotdata.pair_regression(proxy.spot_values(s, d), proxy.pairs(s, d)).select("ligand", "receptor", r6("r"), r6("slope"), r6("intercept"))


@query("SELECT src, dst, round(d, 6) AS d FROM (SELECT src, dst, d, quantile_cont(d, 0.1) OVER () AS bar FROM (SELECT a.obs_id AS src, b.obs_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM (SELECT obs_id, x, y FROM vals JOIN spots USING (obs_id) WHERE gene_id = 2 AND value > (SELECT median(value) FROM vals WHERE gene_id = 2 AND value > 0)) a JOIN (SELECT obs_id, x, y FROM vals JOIN spots USING (obs_id) WHERE gene_id = 3 AND value > (SELECT median(value) FROM vals WHERE gene_id = 3 AND value > 0)) b ON a.obs_id <> b.obs_id)) WHERE d <= bar")
def interaction_pairs(s, d):
    return plotdata.interaction_lines(proxy.spots(s, d), proxy.spot_values(s, d), 2, 3, limit=None).select("src", "dst", r6("d"))


@query("SELECT gene_id, round(i, 6) AS moran_i FROM (SELECT gene_id, n / s0 * num / zz AS i FROM (SELECT gene_id, sum(a.z * b.z) AS num FROM nn JOIN zs a ON a.obs_id = src JOIN zs b USING (gene_id) WHERE b.obs_id = dst GROUP BY 1) JOIN (SELECT gene_id, count(*)::DOUBLE AS n, sum(z * z) AS zz FROM zs GROUP BY 1) USING (gene_id), moments) ORDER BY i DESC, gene_id LIMIT 20")
def moran_top_bar(s, d):
    return plotdata.moran_bar(spatial.morans_i(_graph(s, d), proxy.spot_values(s, d))).select("gene_id", r6("moran_i"))


@query("SELECT obs_id, gene_id, round(greatest(lo, least(hi, value)), 6) + 0.0 AS value FROM vals JOIN (SELECT gene_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM vals GROUP BY 1) USING (gene_id)")
def percentile_clip(s, d):
    return plotdata.clipped(proxy.spot_values(s, d)).select("obs_id", "gene_id", r6("value"))


@query("SELECT CAST(least(31, floor((x - x0) / ((x1 - x0) / 32))) AS INTEGER) AS px, CAST(least(31, floor((y - y0) / ((y1 - y0) / 32))) AS INTEGER) AS py, count(*) AS n FROM spots, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM spots) GROUP BY 1, 2")
def raster_counts(s, d):
    return dynamics.raster(proxy.spots(s, d))


@query(f'SELECT label_a, label_b, round(avg(ratio), 6) AS mean, round(first(ratio ORDER BY bin), 6) AS "first" FROM ({_CO}) GROUP BY 1, 2')
def co_occurrence_export(s, d):
    return sinks.co_occurrence_table(spatial.co_occurrence(proxy.spots(s, d), _labels(s, d))).select("label_a", "label_b", r6("mean"), r6("first"))


@query()
def pca_scores(s, d):
    v, _, _ = embedding.pca(proxy.spot_vectors(s, d), 10)
    return v


@query()
def spatial_communities(s, d):
    return embedding.communities(_graph(s, d), proxy.spots(s, d), 0.5)


@query()
def diffusion_pseudotime(s, d):
    e = neighbors.vector_knn(proxy.spot_vectors(s, d), 10).select("src", "dst", F.exp(-F.col("d")).alias("w"))
    return embedding.pseudotime(embedding.diffusion_map(e), 0)


@query()
def harmony_correction(s, d):
    return integration.harmonise(proxy.spot_vectors(s, d))


@query(f"SELECT obs_id, label, ljc, round((count(*) FILTER (c >= ljc) + 1.0) / 20, 6) AS p_sim FROM (SELECT s.obs_id, s.cluster AS label, count(*) FILTER (o.cluster = s.cluster)::DOUBLE AS ljc FROM spots s LEFT JOIN nn ON src = s.obs_id LEFT JOIN spots o ON o.obs_id = dst GROUP BY 1, 2) l JOIN (SELECT nn.src, p.perm, count(*) FILTER (b.cluster = a.cluster)::DOUBLE AS c FROM nn JOIN {_perms(19, 'spots')} p ON p.obs_id = nn.dst JOIN spots b ON b.obs_id = p.partner JOIN spots a ON a.obs_id = nn.src GROUP BY 1, 2) d ON d.src = l.obs_id GROUP BY 1, 2, 3")
def local_join_count_perm_p(s, d):
    return spatial.local_join_count_p(_graph(s, d), _labels(s, d), 19).select("obs_id", "label", "ljc", r6("p_sim"))


@query("SELECT gene_a, gene_b, round(sum(x * y) / sqrt(sum(abs(x)) * sum(abs(y))), 6) + 0.0 AS r FROM (SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, a.sg AS x, b.sg AS y FROM signs a JOIN signs b ON a.i = b.i AND a.j = b.j AND a.gene_id < b.gene_id) GROUP BY 1, 2".replace("signs a", "(SELECT u.obs_id AS i, w.obs_id AS j, u.gene_id, sign(u.value - w.value) AS sg FROM vals u JOIN vals w ON w.gene_id = u.gene_id AND u.obs_id < w.obs_id) a").replace("signs b", "(SELECT u.obs_id AS i, w.obs_id AS j, u.gene_id, sign(u.value - w.value) AS sg FROM vals u JOIN vals w ON w.gene_id = u.gene_id AND u.obs_id < w.obs_id) b"))
def kendall_corr(s, d):
    return plotdata.correlations(proxy.spot_values(s, d), "kendall").select("gene_a", "gene_b", r6("r"))


_SCALES = "(SELECT avg(x) AS mx, avg(y) AS my FROM spots)"


_KERNELS = f"(SELECT gene_id, kernel, n, (ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa) / ((aa * bb - ab * ab) * yy) AS r2 FROM (SELECT gene_id, kernel, sum(value * a) AS ya, sum(value * b) AS yb, count(*) AS n, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(value * value) - sum(value) * sum(value) / count(*) AS yy FROM (SELECT obs_id, kernel, a - avg(a) OVER (PARTITION BY kernel) AS a, b - avg(b) OVER (PARTITION BY kernel) AS b FROM (SELECT obs_id, 'projection' AS kernel, x AS a, y AS b FROM spots UNION ALL SELECT obs_id, 'gaussian' || CAST(i AS VARCHAR), exp(-cx * cx / (2 * qx[i] * qx[i])), exp(-cy * cy / (2 * qy[i] * qy[i])) FROM (SELECT obs_id, x - mx AS cx, y - my AS cy FROM spots, {_SCALES}) u, (SELECT quantile_cont(abs(x - mx), [0.2, 0.4, 0.6, 0.8, 1.0]) AS qx, quantile_cont(abs(y - my), [0.2, 0.4, 0.6, 0.8, 1.0]) AS qy FROM spots, {_SCALES}) v, range(1, 6) t(i) UNION ALL SELECT obs_id, 'cosine' || CAST(i AS VARCHAR), cos(2 * pi() * cx / qx[i]), cos(2 * pi() * cy / qy[i]) FROM (SELECT obs_id, x - mx AS cx, y - my AS cy FROM spots, {_SCALES}) u, (SELECT quantile_cont(abs(x - mx), [0.2, 0.4, 0.6, 0.8, 1.0]) AS qx, quantile_cont(abs(y - my), [0.2, 0.4, 0.6, 0.8, 1.0]) AS qy FROM spots, {_SCALES}) v, range(1, 6) t(i))) JOIN vals USING (obs_id) GROUP BY 1, 2))"


@query(f"SELECT gene_id, kernel, round(r2, 6) + 0.0 AS r2, round(exp(-n * r2 / 2), 6) AS p FROM {_KERNELS}")
def spatial_kernel_test(s, d):
    from cellweave.operators import spatial_genes

    return spatial_genes.kernel_test(proxy.spot_values(s, d), proxy.spots(s, d)).select("gene_id", "kernel", r6("r2"), r6("p"))


_SVG = f"SELECT gene_id, 0.5 - atan(avg(tan((0.5 - least(1 - 1e-12, greatest(1e-300, exp(-n * r2 / 2)))) * 3.141592653589793))) / 3.141592653589793 AS p FROM {_KERNELS} GROUP BY 1"


@query(f"SELECT gene_id, round(p, 6) AS p, round(min(step) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS q FROM (SELECT gene_id, p, row_number() OVER (ORDER BY p, gene_id) AS place, least(1, p * count(*) OVER () * (SELECT sum(1.0 / i) FROM range(1, 63) t(i)) / row_number() OVER (ORDER BY p, gene_id)) AS step FROM ({_SVG}))")
def spatially_variable_genes(s, d):
    from cellweave.operators import spatial_genes

    return spatial_genes.spatially_variable(proxy.spot_values(s, d), proxy.spots(s, d)).select("gene_id", r6("p"), r6("q"))


@query(f"SELECT obs_id, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 6) AS betweenness FROM spots CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM spots) LEFT JOIN (WITH p AS MATERIALIZED ({_paths_sql()}) SELECT x.t AS v, sum(x.paths * y.paths / z.paths) AS b FROM p z JOIN p x ON x.s = z.s AND x.hops < z.hops JOIN p y ON y.s = x.t AND y.t = z.t AND x.hops + y.hops = z.hops GROUP BY 1) ON v = obs_id")
def node_betweenness(s, d):
    return spatial.betweenness(_graph(s, d), proxy.spots(s, d)).select("obs_id", r6("betweenness"))


@query()
def logistic_regression_markers(s, d):
    from cellweave.operators import markers

    return markers.logistic_markers(preprocess.scale(proxy.spot_values(s, d)), _groups(s, d))


@query("SELECT obs_id, cluster AS cell_type, round(corr(ra, rb), 6) + 0.0 AS rho FROM (SELECT obs_id, gene_id, rank() OVER (PARTITION BY obs_id ORDER BY value) + (count(*) OVER (PARTITION BY obs_id, value) - 1) / 2.0 AS ra FROM vals) a JOIN (SELECT cluster, gene_id, rank() OVER (PARTITION BY cluster ORDER BY m) + (count(*) OVER (PARTITION BY cluster, m) - 1) / 2.0 AS rb FROM (SELECT cluster, gene_id, round(avg(value), 9) AS m FROM vals JOIN spots USING (obs_id) GROUP BY 1, 2)) b USING (gene_id) GROUP BY 1, 2")
def spearman_annotation(s, d):
    v = proxy.spot_values(s, d)
    p = v.join(_groups(s, d), "obs_id").groupBy(F.col("group").alias("cell_type"), "gene_id").agg(F.round(F.avg("value"), 9).alias("value"))
    return annotation.spearman_reference(v, p).select("obs_id", "cell_type", r6("rho"))


@query(f"SELECT label, round(coalesce(touched, 0) / (n - size)::DOUBLE, 6) AS degree_centrality, round(clustering, 6) AS clustering FROM (SELECT cluster AS label, count(*) AS size, (SELECT count(*) FROM spots) AS n FROM spots GROUP BY 1) JOIN (SELECT cluster AS label, avg(clustering) AS clustering FROM spots JOIN ({_TRI}) USING (obs_id) GROUP BY 1) USING (label) LEFT JOIN (SELECT a.cluster AS label, count(DISTINCT other) AS touched FROM (SELECT a AS me, b AS other FROM und UNION ALL SELECT b, a FROM und) e JOIN spots a ON a.obs_id = me JOIN spots b ON b.obs_id = other WHERE a.cluster <> b.cluster GROUP BY 1) USING (label)")
def group_centrality(s, d):
    return domains.group_centrality(_graph(s, d), _labels(s, d)).select("label", r6("degree_centrality"), r6("clustering"))


@query()
def spatial_domains(s, d):
    return domains.spatial_domains(proxy.spot_vectors(s, d), proxy.spots(s, d))


_BATCH = "SELECT batch, gene_id, round(CASE WHEN stddev_samp(disp) OVER w > 0 THEN (disp - avg(disp) OVER w) / stddev_samp(disp) OVER w ELSE 1 END, 9) AS nd FROM (SELECT *, least(20, floor((lm - min(lm) OVER (PARTITION BY batch)) / ((max(lm) OVER (PARTITION BY batch) - min(lm) OVER (PARTITION BY batch)) / 20)) + 1) AS bin FROM (SELECT batch, gene_id, ln(1 + avg(v)) AS lm, ln(var_samp(v) / avg(v)) AS disp FROM (SELECT cluster % 3 AS batch, gene_id, exp(abs(value)) - 1 AS v FROM vals JOIN spots USING (obs_id)) GROUP BY 1, 2 HAVING var_samp(v) > 0)) WINDOW w AS (PARTITION BY batch, bin)"


@query(f"SELECT gene_id, count(*) FILTER (r <= 20) AS n_batches, round(median(nd), 4) + 0.0 AS median_disp FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY nd DESC, gene_id) AS r FROM ({_BATCH})) GROUP BY 1 ORDER BY n_batches DESC, median(nd) DESC, gene_id LIMIT 20")
def variable_genes_by_batch(s, d):
    v = proxy.spot_values(s, d).withColumn("value", F.abs("value"))
    t = preprocess.variable_genes_by_batch(v, proxy.spots(s, d).select("obs_id", (F.col("cluster") % 3).alias("batch")), 20)
    return t.select("gene_id", "n_batches", (F.round("median_disp", 4) + 0.0).alias("median_disp"))


_LISA_P = f"SELECT obs_id, gene_id, local_i, quadrant, (least(above, 19 - above) + 1.0) / 20 AS p FROM ({_LISA}) JOIN (SELECT obs_id, gene_id, count(*) FILTER (plag >= lag) AS above FROM (SELECT perm, src AS obs_id, gene_id, avg(z) AS plag FROM nn JOIN {_perms(19, 'spots')} p ON p.obs_id = dst JOIN (SELECT obs_id AS partner, gene_id, z FROM zs) USING (partner) GROUP BY 1, 2, 3) JOIN lag USING (obs_id, gene_id) GROUP BY 1, 2) USING (obs_id, gene_id)"
_LISA_C = f"SELECT *, CASE WHEN q < 0.3 THEN CASE quadrant WHEN 1 THEN 'HH' WHEN 2 THEN 'LH' WHEN 3 THEN 'LL' ELSE 'HL' END ELSE 'ns' END AS cluster FROM (SELECT *, {sql_bh('p', 'gene_id', 'obs_id')[1]} AS q FROM (SELECT *, {sql_bh('p', 'gene_id', 'obs_id')[0]} FROM ({_LISA_P})))"


@query(f"SELECT gene_id, round(avg(local_i), 5) + 0.0 AS mean_i, round(stddev_pop(local_i), 5) AS sd_i, count(*) FILTER (cluster <> 'ns') AS n_significant, count(*) FILTER (cluster = 'HH') AS n_hotspots, count(*) FILTER (cluster = 'LL') AS n_coldspots, count(*) FILTER (cluster = 'HL') AS n_high_outliers, count(*) FILTER (cluster = 'LH') AS n_low_outliers FROM ({_LISA_C}) GROUP BY 1")
def lisa_clusters(s, d):
    """At 19 permutations, so that SQL can follow; the level is 0.3, under which q can fall there."""
    t = spatial.lisa_summary(spatial.lisa_clusters(spatial.local_morans_p(_graph(s, d), proxy.spot_values(s, d), 19), 0.3))
    return t.select("gene_id", (F.round("mean_i", 5) + 0.0).alias("mean_i"), F.round("sd_i", 5).alias("sd_i"), "n_significant", "n_hotspots", "n_coldspots", "n_high_outliers", "n_low_outliers")


@query(f"SELECT bb, ww, bw, j, round((count(*) FILTER (c >= bb) + 1.0) / 20, 6) AS p_bb FROM (SELECT sum(a * b) / 2.0 AS bb, sum((1 - a) * (1 - b)) / 2.0 AS ww, sum((a - b) * (a - b)) / 2.0 AS bw, count(*) / 2.0 AS j FROM (SELECT (a.cluster % 2)::DOUBLE AS a, (b.cluster % 2)::DOUBLE AS b FROM nn JOIN spots a ON a.obs_id = src JOIN spots b ON b.obs_id = dst)) CROSS JOIN (SELECT p.perm, sum((a.cluster % 2) * (b.cluster % 2)) / 2.0 AS c FROM nn JOIN {_perms(19, 'spots')} p ON p.obs_id = nn.src JOIN {_perms(19, 'spots')} q ON q.perm = p.perm AND q.obs_id = nn.dst JOIN spots a ON a.obs_id = p.partner JOIN spots b ON b.obs_id = q.partner GROUP BY 1) GROUP BY 1, 2, 3, 4")
def join_count_perm_p(s, d):
    labels = proxy.spots(s, d).select("obs_id", F.concat(F.lit("k"), (F.col("cluster") % 2).cast("string")).alias("label"))
    return spatial.join_count_p(_graph(s, d), labels, 19).select("bb", "ww", "bw", "j", r6("p_bb"))


@query(f"SELECT count(*) AS n_features, count(*) FILTER (p < 0.05) AS n_significant, round(avg(i), 6) + 0.0 AS mean_moran_i, (SELECT string_agg(gene_id, ',' ORDER BY k) FROM (SELECT gene_id, row_number() OVER (ORDER BY i DESC, gene_id) AS k FROM m) WHERE k <= 10) AS top FROM m".replace(" m)", " MM)").replace("FROM m", "FROM MM").replace("MM", f"(SELECT gene_id, i, {sql_normal_p('z')} AS p FROM (SELECT gene_id, i, (i - e) / sqrt(v) AS z FROM (SELECT gene_id, n / s0 * num / zz AS i, -1.0 / (n - 1) AS e, (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1.0 / ((n - 1) * (n - 1)) AS v FROM (SELECT gene_id, sum(a.z * b.z) AS num FROM nn JOIN zs a ON a.obs_id = src JOIN zs b USING (gene_id) WHERE b.obs_id = dst GROUP BY 1) JOIN (SELECT gene_id, count(*)::DOUBLE AS n, sum(z * z) AS zz FROM zs GROUP BY 1) USING (gene_id), moments)))"))
def moran_summary(s, d):
    t = summaries.summary("moran", spatial.morans_i(_graph(s, d), proxy.spot_values(s, d)))
    return t.select("n_features", "n_significant", r6(F.col("metrics")["mean_moran_i"], "mean_moran_i"), F.array_join("top_features", ",").alias("top"))


# --- communication: several scores and spatial pairs -------------------------------------------------------------------

_MAG = "SELECT l.grp AS source, r.grp AS target, ligand, receptor, (l.mean + r.mean) / 2 AS a, greatest(0, l.mean * r.mean) AS b, coalesce(sqrt(greatest(0, l.mean * r.mean)) / nullif(sqrt(greatest(0, l.mean * r.mean)) + abs(level), 0), 0) AS c FROM lr JOIN lrm l ON l.gene_id = ligand AND l.fraction >= 0.1 JOIN lrm r ON r.gene_id = receptor AND r.fraction >= 0.1, (SELECT avg(value) AS level FROM vals)"
_SHARE = "(rank() OVER (ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"


@query("SELECT source, target, ligand, receptor, round(least(1, 3 * least(1 - power(1 - r[1], 3), 3 * r[2] * r[2] * (1 - r[2]) + power(r[2], 3), power(r[3], 3))), 6) AS rank FROM (SELECT source, target, ligand, receptor, list_sort([ra, rb, rc]) AS r FROM (SELECT *, " + ", ".join(f"{_SHARE.format(c=c)} AS r{c}" for c in "abc") + " FROM (SELECT source, target, ligand, receptor, round(a, 9) AS a, round(b, 9) AS b, round(c, 9) AS c FROM (" + _MAG + "))))")
def lr_rank_aggregate(s, d):
    m = communication.magnitudes(proxy.spot_values(s, d), _groups(s, d), proxy.pairs(s, d), min_cells=1)
    for c in ("mean", "product", "root"):
        m = m.withColumn(c, F.round(c, 9))
    return communication.rank_aggregate(m).select("source", "target", "ligand", "receptor", r6("rank"))


_NEAR = "(SELECT e.src AS obs_id, ligand, receptor, a.value AS a, b.value AS b FROM (SELECT src, dst FROM nn UNION ALL SELECT obs_id, obs_id FROM spots) e CROSS JOIN lr JOIN vals a ON a.obs_id = e.dst AND a.gene_id = ligand JOIN vals b ON b.obs_id = e.dst AND b.gene_id = receptor)"


@query(f"SELECT obs_id, ligand, receptor, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) + 0.0 AS local FROM {_NEAR} GROUP BY 1, 2, 3")
def lr_local_cosine(s, d):
    return communication.local_similarity(proxy.spot_values(s, d), _graph(s, d), proxy.pairs(s, d)).select("obs_id", "ligand", "receptor", r6("local"))


@query(f"SELECT obs_id, ligand, receptor, round(corr(a, b), 6) + 0.0 AS local FROM {_NEAR} GROUP BY 1, 2, 3")
def lr_local_pearson(s, d):
    return communication.local_similarity(proxy.spot_values(s, d), _graph(s, d), proxy.pairs(s, d), "pearson").select("obs_id", "ligand", "receptor", r6("local"))


@query(f"SELECT obs_id, ligand, receptor, round(count(*) FILTER (a > 0 AND b > 0) / nullif(count(*) FILTER (a > 0 OR b > 0), 0)::DOUBLE, 6) AS local FROM {_NEAR} GROUP BY 1, 2, 3")
def lr_local_jaccard(s, d):
    return communication.local_similarity(proxy.spot_values(s, d), _graph(s, d), proxy.pairs(s, d), "jaccard").select("obs_id", "ligand", "receptor", r6("local"))


_GLOBAL = "SELECT ligand, receptor, sum(x.z * y.lag) AS m, sum(w.lag * y.lag) AS l, any_value(xx.zz) AS zx, any_value(yy.zz) AS zy FROM lr JOIN zs x ON x.gene_id = ligand JOIN lag y ON y.gene_id = receptor AND y.obs_id = x.obs_id JOIN lag w ON w.gene_id = ligand AND w.obs_id = x.obs_id JOIN (SELECT gene_id, sum(z * z) AS zz FROM zs GROUP BY 1) xx ON xx.gene_id = ligand JOIN (SELECT gene_id, sum(z * z) AS zz FROM zs GROUP BY 1) yy ON yy.gene_id = receptor GROUP BY 1, 2"


@query(f"SELECT ligand, receptor, round(any_value(m) / sqrt(any_value(zx) * any_value(zy)), 6) + 0.0 AS moran, round(any_value(l) / sqrt(any_value(zx) * any_value(zy)), 6) + 0.0 AS lee, round((count(*) FILTER (mp >= m - 1e-12) + 1.0) / 20, 6) AS p FROM ({_GLOBAL}) JOIN (SELECT ligand, receptor, perm, sum(x.z * y.lag) AS mp FROM lr JOIN zs x ON x.gene_id = ligand JOIN {_perms(19, 'spots')} p ON p.partner = x.obs_id JOIN lag y ON y.gene_id = receptor AND y.obs_id = p.obs_id GROUP BY 1, 2, 3) USING (ligand, receptor) GROUP BY 1, 2")
def lr_global_moran(s, d):
    t = communication.global_similarity(proxy.spot_values(s, d), _graph(s, d), proxy.pairs(s, d), 19)
    return t.select("ligand", "receptor", r6("moran"), r6("lee"), r6("p"))


# --- permutations at the reference's counts, which SQL is too slow for ------------------------------------------------


@query()
def local_morans_perm_full(s, d):
    return spatial.local_morans_p(_graph(s, d), proxy.spot_values(s, d))


@query()
def local_join_count_perm_full(s, d):
    return spatial.local_join_count_p(_graph(s, d), _labels(s, d))


@query()
def nhood_zscore_perm_full(s, d):
    return spatial.neighbourhood_enrichment(_graph(s, d), _labels(s, d))


@query()
def lr_perm_full(s, d):
    return communication.pair_p_values(proxy.spot_values(s, d), _groups(s, d), proxy.pairs(s, d))


# --- operators on proxies of their own ---------------------------------------------------------------------------------

_PLACES = "(SELECT c_custkey AS obs_id, c_acctbal AS x, (c_custkey * 7919 % 10007)::DOUBLE AS y FROM customer)"


@query(f"SELECT src, dst, round(sqrt(d2), 6) AS d, CAST(rank AS INTEGER) AS rank FROM (SELECT a.obs_id AS src, b.obs_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, row_number() OVER (PARTITION BY a.obs_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.obs_id) AS rank FROM {_PLACES} a JOIN {_PLACES} b ON a.obs_id <> b.obs_id) WHERE rank <= 5")
def knn_grid_edges(s, d):
    """The grid, whatever the number of points."""
    c = proxy.table(s, d, "customer").select(F.col("c_custkey").alias("obs_id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 10007).cast("double").alias("y"))
    return neighbors.knn(c, 5, small=0).select("src", "dst", r6("d"), "rank")


_SCORES = "SELECT obs_id, s.cell_type, round(coalesce(sp / sqrt(np), 0) - coalesce(sn / sqrt(nullif(nn_, 0)), 0), 9) AS score FROM (SELECT obs_id, cell_type, sum(CASE WHEN direction > 0 THEN value * weight ELSE 0 END) AS sp, sum(CASE WHEN direction < 0 THEN value ELSE 0 END) AS sn FROM scaled JOIN (SELECT m.cell_type, m.gene_id, m.direction, coalesce(weight, 1) AS weight FROM markers m LEFT JOIN (SELECT gene_id, CASE WHEN max(f) OVER () > min(f) OVER () THEN 1.0 - (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) ELSE 1 END AS weight FROM (SELECT gene_id, count(DISTINCT cell_type)::DOUBLE AS f FROM markers WHERE direction > 0 GROUP BY 1)) USING (gene_id)) USING (gene_id) GROUP BY 1, 2) s JOIN (SELECT cell_type, count(*) FILTER (direction > 0)::DOUBLE AS np, count(*) FILTER (direction < 0)::DOUBLE AS nn_ FROM markers GROUP BY 1) USING (cell_type)"


@query(f"SELECT cell_type, count(*) AS n, round(avg(confidence), 5) AS confidence FROM (SELECT obs_id, CASE WHEN max(score) > 0 THEN first(cell_type ORDER BY score DESC, cell_type) ELSE 'Unknown' END AS cell_type, CASE WHEN max(score) > 0 THEN max(e) / sum(e) ELSE 0 END AS confidence FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY obs_id)) AS e FROM ({_SCORES})) GROUP BY 1) GROUP BY 1")
def annotation_confidence(s, d):
    scores = annotation.marker_scores(preprocess.scale(proxy.spot_values(s, d)), proxy.types(s, d)).withColumn("score", F.round("score", 9))
    return annotation.confidence_by_type(annotation.assign(scores), 5)


@query("SELECT obs_id, CASE WHEN cluster < 6 THEN 'c' || CAST(cluster % 4 AS VARCHAR) ELSE 'Unknown' END AS cell_type FROM spots")
def mapped_clusters(s, d):
    names = s.range(6).select(F.col("id").cast("int").alias("cluster"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("cell_type"))
    return annotation.map_clusters(proxy.spots(s, d).select("obs_id", "cluster"), names)


@query("SELECT m.obs_id, m.set_name, round(m.score - ms - bx * (x - mx) - b_y * (y - my), 6) + 0.0 AS score FROM (SELECT obs_id, 'set' || CAST(gene_id % 5 AS VARCHAR) AS set_name, avg(value) AS score FROM vals GROUP BY 1, 2) m JOIN spots USING (obs_id) JOIN (SELECT set_name, mx, my, ms, (xs * yy - ys * xy) / (xx * yy - xy * xy) AS bx, (ys * xx - xs * xy) / (xx * yy - xy * xy) AS b_y FROM (SELECT set_name, avg(x) AS mx, avg(y) AS my, avg(score) AS ms, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, score) AS xs, covar_pop(y, score) AS ys FROM (SELECT obs_id, 'set' || CAST(gene_id % 5 AS VARCHAR) AS set_name, avg(value) AS score FROM vals GROUP BY 1, 2) JOIN spots USING (obs_id) GROUP BY 1)) USING (set_name)")
def set_score_detrended(s, d):
    from cellweave.operators import enrichment

    sets = s.range(2, 64).select(F.concat(F.lit("set"), (F.col("id") % 5).cast("string")).alias("set_name"), F.col("id").cast("int").alias("gene_id"))
    m = enrichment.mean_score(proxy.spot_values(s, d), sets)
    return enrichment.detrended(m, proxy.spots(s, d)).select("obs_id", "set_name", r6("score"))


@query(f"SELECT label, round(sum(ljc), 6) AS total, round(avg(ljc), 6) AS mean, round(stddev_pop(ljc), 6) AS sd, count(*) FILTER (p < 0.1) AS n_significant FROM (SELECT obs_id, label, ljc, (count(*) FILTER (c >= ljc) + 1.0) / 20 AS p FROM (SELECT s.obs_id, s.cluster AS label, count(*) FILTER (o.cluster = s.cluster)::DOUBLE AS ljc FROM spots s LEFT JOIN nn ON src = s.obs_id LEFT JOIN spots o ON o.obs_id = dst GROUP BY 1, 2) l JOIN (SELECT nn.src, p.perm, count(*) FILTER (b.cluster = a.cluster)::DOUBLE AS c FROM nn JOIN {_perms(19, 'spots')} p ON p.obs_id = nn.dst JOIN spots b ON b.obs_id = p.partner JOIN spots a ON a.obs_id = nn.src GROUP BY 1, 2) d ON d.src = l.obs_id GROUP BY 1, 2, 3) GROUP BY 1")
def local_join_summary(s, d):
    t = spatial.local_join_summary(spatial.local_join_count_p(_graph(s, d), _labels(s, d), 19), 0.1)
    return t.select("label", r6("total"), r6("mean"), r6("sd"), "n_significant")


@query("SELECT round(avg(cnv), 6) + 0.0 AS mean, round(stddev_pop(cnv), 6) AS sd, round(median(cnv), 6) + 0.0 AS median, count(DISTINCT obs_id) AS n_cells FROM cnv")
def cnv_statistics(s, d):
    return cnv.statistics(_profile(s, d)).select(r6("mean"), r6("sd"), r6("median"), "n_cells")


@query("SELECT cluster AS label, round(avg(degree), 6) AS degree FROM spots JOIN (SELECT i, count(*) AS degree FROM (SELECT a AS i FROM und UNION ALL SELECT b FROM und) GROUP BY 1) ON i = obs_id GROUP BY 1")
def degree_by_label(s, d):
    return spatial.centrality_by_label(neighbors.degree(_graph(s, d)), _labels(s, d), "degree").select("label", r6("degree"))


_BISECTOR = "SELECT a.obs_id AS src, b.obs_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, (a.x - b.x) * (k.y - (a.y + b.y) / 2) - (a.y - b.y) * (k.x - (a.x + b.x) / 2) AS s, (k.x - (a.x + b.x) / 2) * (k.x - (a.x + b.x) / 2) + (k.y - (a.y + b.y) / 2) * (k.y - (a.y + b.y) / 2) - ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 4 AS q FROM spots a JOIN spots b ON a.obs_id < b.obs_id JOIN spots k ON k.obs_id <> a.obs_id AND k.obs_id <> b.obs_id"


@query(f"SELECT src, dst, round(d, 6) AS d FROM ({_BISECTOR}) GROUP BY src, dst, d HAVING coalesce(max(CASE WHEN s < 0 THEN q / (2 * s) END), -1e300) < coalesce(min(CASE WHEN s > 0 THEN q / (2 * s) END), 1e300)")
def delaunay_edges(s, d):
    """Edges of the triangulation; the SQL asks of every pair whether some circle through both is empty."""
    return delaunay.delaunay_edges(proxy.spots(s, d)).select("src", "dst", r6("d"))


@query("SELECT round(2 * sum(inner_) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 9) AS modularity FROM (SELECT c, sum(inner_) AS inner_, sum(k) AS k FROM (SELECT a.cluster AS c, CASE WHEN a.cluster = b.cluster THEN 1.0 ELSE 0.0 END AS inner_, 1.0 AS k FROM nn JOIN spots a ON a.obs_id = src JOIN spots b ON b.obs_id = dst UNION ALL SELECT b.cluster, 0.0, 1.0 FROM nn JOIN spots b ON b.obs_id = dst) GROUP BY c)")
def cluster_modularity(s, d):
    return leiden.modularity(_graph(s, d), proxy.spots(s, d)).select(F.round("modularity", 9).alias("modularity"))


@query()
def gaussian_process_genes(s, d):
    return spatial_genes.gaussian_process(proxy.spot_values(s, d), proxy.spots(s, d))
