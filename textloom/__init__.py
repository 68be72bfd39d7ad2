"""textloom: corpus analytics, retrieval and verification as Spark plans."""
