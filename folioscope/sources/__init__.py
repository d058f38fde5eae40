"""Readers of the input tables."""
from .tables import read_table, ship_package

__all__ = ["read_table", "ship_package"]
