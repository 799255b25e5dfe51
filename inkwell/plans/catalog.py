"""All queries over the given tables, with their DuckDB twins."""

from inkwell.plans import asks, checks, concepts, corpus, curation, everyday, feeds, graphs, greedy, library, matches, mining, people, phrases, repair, retrieve, sampling, search, spans, star, structure, training  # noqa: F401
from inkwell.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
