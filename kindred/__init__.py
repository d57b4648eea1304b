"""A PySpark engine for entity resolution over semi-structured records."""
