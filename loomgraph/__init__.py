"""Property-graph retrieval, conversation analytics and text ingest on Spark DataFrames."""
