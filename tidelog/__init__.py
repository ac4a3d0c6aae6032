"""Log analytics on Spark: ingest, search, time-bucket counts, retention, reports."""
