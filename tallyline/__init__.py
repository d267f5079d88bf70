"""tallyline: analytics over per-item measurements of competing systems, on Spark DataFrames.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (column expressions and
scorers), ``operators`` (joins, ranks, tests, roll-ups, dataset algebra, checks),
``plans`` (composed reports), ``streaming`` and ``queries`` (the registry that
``__spark_entry__.py`` publishes).
"""

__all__ = ["operators", "sources", "functions", "plans", "streaming", "queries"]
