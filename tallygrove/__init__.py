"""A PySpark-native engine for job-posting data: ingest, extraction, listing, indexing, retrieval."""
