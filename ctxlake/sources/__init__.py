"""Readers and writers."""
from ctxlake.sources.tables import table

__all__ = ["table"]
