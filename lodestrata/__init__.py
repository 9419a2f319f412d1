"""A Spark-first engine for corpus curation and structural retrieval."""
