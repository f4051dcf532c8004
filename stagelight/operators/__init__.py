"""Operators: filters, joins and aggregation building blocks (DataFrame -> DataFrame)."""
