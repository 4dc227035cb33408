"""The registered queries."""

from . import catalogs, images, records, relational, scalars, stateful, streams, transitions  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
