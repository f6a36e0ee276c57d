"""A Spark-native retrieval memory: ingestion, hybrid search, usage analytics and ranking evaluation."""
