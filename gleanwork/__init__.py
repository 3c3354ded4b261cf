"""Job-posting ingest and search as Spark DataFrame and Structured Streaming jobs."""
