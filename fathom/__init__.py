"""Page search on Spark: page ingestion, inverted index, ranked search, URL submissions."""
