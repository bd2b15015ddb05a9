"""Named queries over the driver tables, each with the SQL that states its result."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(name -> callable(spark, folder), name -> SQL)."""
    from spanseek.catalogue import eval_queries, registry, search_queries, split_queries, text_queries, vector_queries  # noqa: F401

    return dict(registry.QUERIES), dict(registry.SQL)
