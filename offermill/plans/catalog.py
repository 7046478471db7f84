"""All registered queries; importing a module registers its queries."""

from . import extraction, feeds, ingestion, reporting, resolution, serving, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
