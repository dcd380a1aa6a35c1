"""The chained query language: text to syntax tree, and a builder that makes the same tree."""

from .builder import Q, agg, col, fn, lit
from .parser import parse

__all__ = ["Q", "agg", "col", "fn", "lit", "parse"]
