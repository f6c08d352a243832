"""Record layouts of streams and tables."""

from __future__ import annotations

# Streams, one text per topic.
FINGERPRINT_EVENT = (
    "event_id bigint, device_id string, fingerprint_hash string, timestamp_utc bigint, "
    "manufacturer string, model string, ip_address string, ingested_at bigint"
)
UNMATCHED_EVENT = (
    "device_id string, fingerprint_hash string, timestamp_utc bigint, manufacturer string, "
    "model string, ip_address string"
)
VIEWERSHIP_EVENT = (
    "device_id string, content_id string, title string, network string, genre string, "
    "match_confidence float, watch_start_utc bigint, duration_sec int, manufacturer string, "
    "model string, ip_address string"
)
REFERENCE_EVENT = (
    "fingerprint_hash string, content_id string, title string, network string, genre string, "
    "episode string, airdate string, confidence double"
)
# The time is ISO text; `streams.consents_from` makes it `consent_time` in seconds.
CONSENT_EVENT = (
    "device_id string, opted_in boolean, timestamp string, jurisdiction string, tcf_string string"
)
BILLING_EVENT = "advertiser_id bigint, event_type string, amount_cents bigint"
SEGMENT_EVENT = "segment_id string, device_id string, event_type string"

# Requests and tables.
INGEST_BATCH = (
    "api_key string, received_at bigint, "
    f"batch array<struct<{FINGERPRINT_EVENT.replace(', ', ',').replace(' ', ':')}>>"
)
MANIFEST = (
    "items array<struct<content_id:string,title:string,network:string,genre:string,"
    "episode:string,airdate:string,wav:string,confidence:double>>"
)
AUDIT_LOG = (
    "log_id string, timestamp timestamp, action string, device_id_hash string, "
    "jurisdiction string, operator_id string, metadata map<string,string>"
)
DELETION_AUDIT = (
    "execution_time string, viewership_deleted_count bigint, aggregates_archived_count bigint, "
    "status string"
)
