"""Spanning-forest analytics over temporal graphs on PySpark."""
