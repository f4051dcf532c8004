"""stagelight: course-business analytics as Spark DataFrame plans.

Layout:
  sources/    role schemas, fixed literal relations, role loaders
  functions/  column expressions (calendar, buckets, text)
  operators/  filters, joins, aggregation building blocks
  plans/      frames, analyses, registered query catalogue, DuckDB oracle
"""

__version__ = "0.1.0"
