"""A PySpark engine for personnel documents and records."""
