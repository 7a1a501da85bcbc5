"""Importing this registers every query."""

from parity import columns, documents, models, relational  # noqa: F401
from parity.registry import CASES

__all__ = ["CASES"]
