"""Driver tables as domain tables, and the registered queries with their SQL."""

from . import queries, tile_queries

__all__ = ["queries", "tile_queries"]
