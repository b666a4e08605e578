"""PySpark retrieval, catalog analytics and corpus preparation."""
