"""All registered queries of the reference's operators."""

from . import articles, ingest, markup, older, posts, review, scalars  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
