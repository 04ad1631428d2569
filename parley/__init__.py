"""parley: conversation analytics as PySpark DataFrame operators."""
