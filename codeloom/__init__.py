"""A PySpark analytics engine for code-knowledge graphs, text search and event streams."""
