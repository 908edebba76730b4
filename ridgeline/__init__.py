"""A PySpark engine for recorded outdoor activities."""
