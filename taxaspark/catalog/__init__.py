"""Registered queries with their DuckDB twins."""

from importlib import import_module

_MODULES = ("tables_and_cleaning", "features", "classification", "baselines", "evaluation", "reports_and_streams")


def load():
    """(queries, oracle statements), in inventory order."""
    from taxaspark.catalog.registry import ORACLES, QUERIES

    for name in _MODULES:
        import_module(f"taxaspark.catalog.{name}")
    return QUERIES, ORACLES
