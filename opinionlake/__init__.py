"""Review analytics on Spark: ingest, clean, featurise, compare, retrieve."""
