"""Event ingestion, geo-resolution and radius search as PySpark DataFrame operators."""
