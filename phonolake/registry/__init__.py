"""All registered queries and their oracles."""

from phonolake.registry import examples, scores, sounds, tables, texts  # noqa: F401
from phonolake.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
