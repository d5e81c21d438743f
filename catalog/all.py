"""Imports every module that adds to the catalog."""

import importlib

from catalog import CATALOG

for _part in ("rules", "windows", "sessions", "tables", "texts", "stores", "streams"):
    importlib.import_module(f"catalog.{_part}")

__all__ = ["CATALOG"]
