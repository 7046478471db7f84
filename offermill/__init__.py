"""offermill - listing ingestion, entity resolution and ranking as Spark jobs."""
