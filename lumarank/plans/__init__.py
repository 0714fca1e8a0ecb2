"""Query definitions over the library's tables."""

from importlib import import_module

MODULES = ("scores", "library", "labels", "bursts", "benchmarks", "texts")


def load_queries() -> None:
    """Imports every module that registers queries."""
    for name in MODULES:
        import_module(f"lumarank.plans.{name}")
