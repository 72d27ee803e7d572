"""Event and transaction analytics as PySpark DataFrame operators."""
