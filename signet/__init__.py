"""signet: authority and identity analytics as PySpark DataFrame operators."""
