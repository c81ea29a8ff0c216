"""Queries over the shared test tables, one per operator, with SQL checks."""

from importlib import import_module
from pathlib import Path

from catalog.registry import CHECKS, QUERIES

for _module in sorted(p.stem for p in Path(__file__).parent.glob("*.py")):
    if _module not in ("__init__", "registry", "views"):
        import_module(f"catalog.{_module}")

__all__ = ["CHECKS", "QUERIES"]
