"""kinweave: evidence-based lineage analytics as PySpark DataFrame pipelines."""
