"""Registered queries, one module for each area of the library."""

from importlib import import_module

MODULES: tuple[str, ...] = ("policy", "bureau", "texts", "documents", "forms", "streams", "extract", "sinks", "runs", "fields", "labels", "reports", "marked")


def load() -> None:
    for name in MODULES:
        import_module(f"lendmill.plans.{name}")
