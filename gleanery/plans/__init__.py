"""The registered queries and their SQL; importing the package registers all."""

from gleanery.plans import io_queries, net_queries, queries

__all__ = ["io_queries", "net_queries", "queries"]
