"""Operators for large training-data pipelines over the ``documents`` table.

Nothing outside this folder imports it.  ``queries.py`` registers one query per
operator, each over its whole table.
"""
