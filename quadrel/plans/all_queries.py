"""Importing this registers every query."""

from . import q_graph, q_local, q_more, q_policy, q_raster, q_score, q_shapes, q_stages, q_study, q_tables  # noqa: F401
