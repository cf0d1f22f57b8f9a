"""Registered queries, one module per operator family."""

from importlib import import_module

MODULES = ["graph", "detectors", "windows", "joins", "statistics", "gates", "feeds", "text", "verification",
           "exports", "live"]


def load_all() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")
