"""quadloom: a PySpark engine for profiling, transforming and searching graph-shaped data."""

__version__ = "0.1.0"
