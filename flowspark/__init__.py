"""Transfer-flow analytics as PySpark table operators."""
