"""srcatlas: source-corpus analytics as lazy PySpark DataFrame operators.

Layout:
  functions/  Column -> Column expressions (paths, text, code facts, vectors)
  operators/  DataFrame -> DataFrame operators (policy, chunking, analysis, ...)
  sources/    readers: file-tree data source, decode, tables, test fixtures
  plans/      registered queries (Spark) and their DuckDB oracle statements
  streaming/  incremental ingest on Structured Streaming (foreachBatch)
"""

__version__ = "0.1.0"
