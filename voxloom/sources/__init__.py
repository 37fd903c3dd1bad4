"""Readers and writers."""

from voxloom.sources.tables import table

__all__ = ["table"]
