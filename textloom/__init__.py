"""textloom: a Spark-first engine for building, indexing, searching and measuring text corpora."""
