"""Quality, change-ingest and rollup operators for a mutable record feed, on Spark DataFrames."""

from tidemark.config import RunConfig, configure

__all__ = ["RunConfig", "configure"]
