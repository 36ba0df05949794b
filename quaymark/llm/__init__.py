"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
registered queries and their SQL; each other module is one operator.
"""
