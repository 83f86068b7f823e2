"""Relational and element-wise operators as Spark expressions."""
