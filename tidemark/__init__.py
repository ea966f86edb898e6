"""A PySpark engine for document retrieval, interval analytics and training-data pipelines."""
