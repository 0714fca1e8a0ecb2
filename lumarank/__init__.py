"""lumarank: a PySpark-native engine for scoring, grouping and ranking photo libraries."""

__all__ = ["__version__"]
__version__ = "0.1.0"
