"""Text verification, evidence retrieval and corpus preparation on PySpark."""
