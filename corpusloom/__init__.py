"""A PySpark engine for document retrieval and corpus analytics."""
