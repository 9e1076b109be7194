"""A code-intelligence and training-data analytics engine on PySpark."""
