"""Event-log sequence and timing analytics on PySpark."""
