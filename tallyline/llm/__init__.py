"""Operators for preparing and auditing training and evaluation data at scale.

Nothing else in the library imports this sub-package; ``__spark_entry__.py`` adds its
queries when it can be imported.
"""
