"""Methods by name, and how to add one."""

from __future__ import annotations

from collections.abc import Callable

from cellweave.errors import ParameterError

_METHODS: dict[str, dict[str, Callable]] = {}


def register_method(family: str, name: str, fn: Callable) -> Callable:
    _METHODS.setdefault(family, {})[name] = fn
    return fn


def method(family: str, name: str) -> Callable:
    try:
        return _METHODS[family][name]
    except KeyError:
        raise ParameterError(f"unknown {family} method {name}; known: {', '.join(methods(family))}") from None


def methods(family: str) -> list[str]:
    return sorted(_METHODS.get(family, {}))


def _defaults() -> None:
    from cellweave.operators import annotation, communication, deconvolution, delaunay, domains, dynamics, embedding, enrichment, external, factors, integration, leiden, marker_mixture, neighbors, null_laws, spatial, spatial_genes

    for family, table in {
        "deconvolution": deconvolution.METHODS | {"factors": factors.factor_proportions},
        "statistics": {n: getattr(spatial, n) for n in ("morans_i", "gearys_c", "local_morans", "getis_ord", "bivariate_moran", "join_count", "local_join_count", "neighbourhood_enrichment", "co_occurrence", "ripley_l", "ripley_envelopes", "network_properties", "local_morans_p", "join_count_p", "local_join_count_p", "closeness", "betweenness")},
        "enrichment": {"ora": enrichment.over_representation, "gsea": enrichment.prerank, "ssgsea": enrichment.ssgsea, "mean": enrichment.mean_score, "web": enrichment.web_service},
        "annotation": {"markers": annotation.marker_scores, "spearman": annotation.spearman_reference, "mixture": marker_mixture.assign, "learned": annotation.learned_model},
        "integration": {"harmony": integration.harmonise, "bbknn": integration.batch_balanced_knn, "mnn": integration.mutual_pairs, "variational": integration.variational},
        "spatial_genes": spatial_genes.METHODS,
        "domains": {"communities": domains.spatial_domains},
        "communication": {"mean": communication.pair_scores, "permutation": communication.pair_p_values, "cauchy": communication.combined_p, "rank_aggregate": communication.rank_aggregate, "local": communication.local_similarity, "global": communication.global_similarity, "analytic": null_laws.analytic_p_values, "analytic_combined": null_laws.combined_p_values},
        "velocity": {"moments": dynamics.moments, "steady_state": dynamics.velocity, "graph": dynamics.velocity_graph},
        "registration": {"similarity": integration.align, "transport": dynamics.transport},
        "communities": {"leiden": leiden.leiden, "label_propagation": embedding.label_propagation},
        "graphs": {"knn": neighbors.knn, "radius": neighbors.radius_edges, "grid": neighbors.grid_ring_edges, "delaunay": delaunay.delaunay_edges},
    }.items():
        for name, fn in table.items():
            register_method(family, name, fn)
    for family, names in external.SUBSTITUTES.items():
        for name in names:
            register_method(family, name, external.external(family, name))


_defaults()
