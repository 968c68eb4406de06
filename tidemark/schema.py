"""Explicit schemas of the feed and the stored tables (the latter as DDL text)."""

from pyspark.sql import types as T

from tidemark.fixed_values import UPDATE_TIME_FIELDS

# Payload fields of one feed record. Everything arrives as text (or is absent).
FEED_FIELDS = (
    "unique_key",
    "created_date",
    "closed_date",
    "agency",
    "agency_name",
    "complaint_type",
    "descriptor",
    "status",
    "borough",
    "incident_zip",
    "incident_address",
    "street_name",
    "latitude",
    "longitude",
    "resolution_description",
)

FEED_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in (":id", *UPDATE_TIME_FIELDS, *FEED_FIELDS)]
)

# The served columns of one record, in table order.
CLEAN_FIELDS = (
    "unique_key",
    "created_date",
    "closed_date",
    "agency",
    "agency_name",
    "complaint_type",
    "complaint_type_norm",
    "descriptor",
    "status",
    "borough",
    "incident_zip",
    "incident_address",
    "address_norm",
    "latitude",
    "longitude",
    "resolution_description",
    "source_updated_at",
    "defect_count",
    "zip_borough_conflict",
    "unrecognized_type",
)

CLEAN_SCHEMA = """
    unique_key STRING, created_date TIMESTAMP, closed_date TIMESTAMP, agency STRING,
    agency_name STRING, complaint_type STRING, complaint_type_norm STRING, descriptor STRING,
    status STRING, borough STRING, incident_zip STRING, incident_address STRING,
    address_norm STRING, latitude DOUBLE, longitude DOUBLE, resolution_description STRING,
    source_updated_at TIMESTAMP, defect_count INT, zip_borough_conflict BOOLEAN,
    unrecognized_type BOOLEAN, is_duplicate_of STRING, updated_at TIMESTAMP
    """

RAW_SCHEMA = """
    unique_key STRING, payload STRING, source_updated_at TIMESTAMP, created_date TIMESTAMP,
    ingested_at TIMESTAMP, ingest_run_id BIGINT, seen_count BIGINT
    """

FAILURE_TYPE = "struct<rule:string,severity:string,detail:string,field_value:string>"

FAILURES_SCHEMA = """
    unique_key STRING, rule STRING, severity STRING, detail STRING, field_value STRING,
    ingest_run_id BIGINT, detected_at TIMESTAMP
    """

DAILY_SCHEMA = """
    day DATE, borough STRING, complaint_type_norm STRING, request_count BIGINT,
    closed_count BIGINT, median_hours_to_close DOUBLE, defect_count BIGINT,
    duplicate_count BIGINT, computed_at TIMESTAMP
    """

RUN_COUNTERS = (
    "pages_fetched",
    "rows_fetched",
    "rows_inserted",
    "rows_updated",
    "rows_rejected",
    "rows_flagged",
    "duplicates_collapsed",
    "links_new",
    "unrecognized_types",
    "raw_pruned",
    "clean_pruned",
)

RUNS_SCHEMA = (
    "id BIGINT, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, trigger STRING, "
    "watermark_before TIMESTAMP, watermark_after TIMESTAMP, "
    + ", ".join(f"{c} BIGINT" for c in RUN_COUNTERS)
    + ", duration_seconds DOUBLE, error STRING"
)

QUARANTINE_SCHEMA = "payload STRING, source_updated_at TIMESTAMP, ingest_run_id BIGINT, detected_at TIMESTAMP"

STORED_TABLES = {
    "clean": CLEAN_SCHEMA,
    "raw": RAW_SCHEMA,
    "failures": FAILURES_SCHEMA,
    "quarantine": QUARANTINE_SCHEMA,
    "daily": DAILY_SCHEMA,
    "runs": RUNS_SCHEMA,
}
