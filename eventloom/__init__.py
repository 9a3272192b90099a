"""Event-sequence analytics and training-data preparation on PySpark."""
