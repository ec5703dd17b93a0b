"""Market and news analytics expressed as PySpark DataFrame jobs."""
