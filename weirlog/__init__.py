"""Event-log analytics on PySpark: DataFrame operators, sources, plans and streaming wrappers."""
