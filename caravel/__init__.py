"""Dataset delivery and analytics on PySpark."""
