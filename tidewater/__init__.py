"""Temporal-interaction analytics and training-data operators on PySpark."""
