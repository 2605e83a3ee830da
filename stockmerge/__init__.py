"""Catalog harmonisation as Spark DataFrame operators."""
