"""Every operator as a query over the provided tables, with its SQL."""

from kinlink.catalogue.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
