"""DataFrame operators: retrieval, verification, metrics, windows, documents, projection."""
