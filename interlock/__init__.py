"""interlock: shape- and similarity-matching pipelines as PySpark plans."""

__version__ = "0.1.0"
