"""Open-source-intelligence analytics as PySpark DataFrame operators."""
