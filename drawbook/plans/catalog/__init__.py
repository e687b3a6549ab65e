"""Importing this package fills the catalogue."""

from importlib import import_module

MODULES = ["results", "scores", "texts", "names", "reroute", "attention", "checks", "reads", "scans", "evidence", "layout", "printed", "ledger", "outputs"]

for _name in MODULES:
    import_module(f"{__name__}.{_name}")
