"""The nine operators of the plan language, as functions of DataFrames."""

from . import rows, sets  # noqa: F401  they register themselves
from .base import REGISTRY, Context

__all__ = ["REGISTRY", "Context"]
