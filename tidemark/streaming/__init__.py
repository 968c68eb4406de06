"""The ingest run, in batch and as a stream."""
