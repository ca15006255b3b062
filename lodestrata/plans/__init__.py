"""Queries over the driver's tables, with the SQL that each is held against."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ("text", "names", "browse", "vectors", "matching", "scoring", "flows", "stewardship", "policies", "reports", "more", "pages", "interfaces", "extraction", "inbox", "registers"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
