"""Methods that need torch, R, a web service or a language model: known by name, with the native operator to use instead."""

from __future__ import annotations

from collections.abc import Callable

from cellweave.errors import DependencyError, ParameterError

#: family -> method -> what to use here.
SUBSTITUTES = {
    "normalisation": {"sctransform": "regularised.residuals", "scvi": "preprocess.normalise"},
    "embedding": {"umap": "the first two components of embedding.pca"},
    "domains": {"spagcn": "domains.spatial_domains", "stagate": "domains.spatial_domains", "graphst": "domains.spatial_domains"},
    "spatial_genes": {"spatialde": "spatial_genes.gaussian_process"},
    "annotation": {"tangram": "deconvolution.proportions", "scanvi": "annotation.marker_scores", "cellassign": "annotation.marker_scores", "language_model": "annotation.map_clusters"},
    "communication": {"cellchat": "communication.pair_p_values", "fastccc": "null_laws.combined_p_values"},
    "velocity": {"dynamical": "dynamics.velocity", "velovi": "dynamics.velocity"},
    "trajectory": {"palantir": "embedding.pseudotime", "gpcca": "dynamics.absorption"},
    "integration": {"scvi": "integration.harmonise", "scanorama": "integration.mutual_pairs"},
    "registration": {"paste": "dynamics.registered", "stalign": "dynamics.raster"},
    "cnv": {"numbat": "cnv.infer"},
    "enrichment": {"enrichr": "enrichment.over_representation"},
}


def external(family: str, name: str) -> Callable:
    """A function that says what is missing and what to use."""
    try:
        instead = SUBSTITUTES[family][name]
    except KeyError:
        raise ParameterError(f"unknown external method {family}/{name}") from None

    def missing(*_, **__):
        raise DependencyError(f"{name} is not available here; use {instead}")

    return missing
