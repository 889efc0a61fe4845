"""All registered queries; importing a catalog module registers its own."""

from __future__ import annotations

from . import (  # noqa: F401
    catalog_code,
    catalog_corpus,
    catalog_graph,
    catalog_hierarchy,
    catalog_learning,
    catalog_retrieval,
    catalog_sync,
    catalog_stream,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
