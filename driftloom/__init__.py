"""Concept-drift analytics for document streams, written as PySpark DataFrame operators."""
