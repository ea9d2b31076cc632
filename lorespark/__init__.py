"""Memory, retrieval and corpus analytics as declarative PySpark plans."""
