"""Lead intelligence over company registers, as PySpark DataFrame jobs."""
