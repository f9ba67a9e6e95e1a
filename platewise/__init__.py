"""platewise: experiment screening and campaign analysis as Spark DataFrame operators.

Sub-packages
------------
sources    readers, writers and the shared fixture views (DataFrame and SQL form)
functions  Column-expression building blocks (kernels, acquisitions, normal cdf, hashing)
operators  DataFrame -> DataFrame operators, one module per survey section
plans      the query catalogue wired into ``__spark_entry__`` (Spark query + DuckDB oracle)
streaming  Structured Streaming monitors
"""

__all__ = ["session"]
