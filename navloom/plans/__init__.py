"""Runnable queries: adapters -> operators -> final projection."""


def catalog():
    """All registered queries by name."""
    import importlib

    from navloom.plans.registry import QUERIES

    for module in MODULES:
        importlib.import_module(f"navloom.plans.{module}")
    return QUERIES


MODULES = ["screen", "nav", "holdings", "ledger", "themes", "position", "quality", "history", "reconcile", "ingest",
           "records"]
