"""Retrieval-style localization analytics on Spark DataFrames."""

from .functions.geo import preparation
from .operators.knn import knn_join
from .operators.knn_index import Index, open_index, search
from .operators.knn_index import build as store_index
from .operators.tiles import tile_count, tile_grid
from .plans.evaluate import ablate, evaluate, scalability
from .plans.localize import build_index, build_site, extract, image_descriptors, k_sweep, locate, match, query_images, report, truth_and_top
from .plans.surface import register


def query_top_n_patches(queries, index, patches, n: int = 100, k: int = 5):
    """(image, top_n) of the n most voted patches."""
    return query_images(queries, index, patches, k=k, n=n).select("image", "top_n")


__all__ = ["Index", "ablate", "build_index", "build_site", "evaluate", "extract", "image_descriptors", "k_sweep", "knn_join", "locate", "match", "open_index", "preparation", "query_images", "query_top_n_patches", "register", "report", "scalability", "search", "store_index", "tile_count", "tile_grid", "truth_and_top"]
