"""Coordinated-influence analytics on PySpark."""
