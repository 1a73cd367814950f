"""Density hierarchies (core distance, spanning tree, dendrogram) as Spark DataFrame operations."""

from sparkgrove.plans.hierarchy import dendrogram_of, density_tree, euclidean_tree, linkage, to_linkage
from sparkgrove.sources.points import from_columns, from_numpy, read_points

__all__ = ["dendrogram_of", "density_tree", "euclidean_tree", "from_columns", "from_numpy", "linkage", "read_points", "to_linkage"]
