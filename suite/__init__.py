"""Registered queries: every operator over the test tables, each with the SQL that must give the same rows."""

from importlib import import_module

MODULES = ("relational", "quality_checks", "history", "rule_checks", "imports", "files", "streams", "competing")


def load() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        import_module(f"suite.{name}")
