"""Contrasto: divergent-knowledge analytics expressed as PySpark DataFrame transformations."""
