"""Registered queries; importing this package fills the registry."""

from kinweave.plans import analysis_queries, archive_queries, graph_queries, kin_queries, more_queries, relational_queries, source_queries, text_queries  # noqa: F401
