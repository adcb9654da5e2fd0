"""tidemark: point-in-time analytics and training-data operators as PySpark plans."""
