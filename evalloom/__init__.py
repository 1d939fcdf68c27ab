"""Evaluation analytics for model answers, as PySpark DataFrame operators."""
