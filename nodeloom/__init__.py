"""Relational vector engine on PySpark: dictionary graphs, similarity joins, hierarchies and text preparation."""
