"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; ``queries.py`` lists what
``__spark_entry__`` adds when the subpackage is present.
"""
