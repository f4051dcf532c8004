"""Operators for training-data pipelines over the ``documents``, ``pages``,
``benchmark`` and ``labels`` tables.

Nothing outside this package imports it. ``registry.QUERIES`` holds one query
per operator, ``registry.ORACLE_SQL`` the DuckDB SQL where SQL can express it.
"""
