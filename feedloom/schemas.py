"""Schemas of the stored tables (DDL)."""

SOURCES = "id string, display_name string, fetcher_type string, config_json string, enabled boolean, health_score double, last_success_at timestamp, last_error string"
ITEMS = "id string, source_id string, url string, raw_url string, title string, content string, author string, published_at timestamp, fetched_at timestamp, kind string, classified_at timestamp, notion_archived_at timestamp"
EVENT_METADATA = "item_id string, event_date date, registration_deadline date, location string, registration_url string, registration_contact string, extracted_at timestamp"
EVENT_PUSHES = "item_id string, pushed_at timestamp, digest_id string"
TOPICS = "id string, name string, summary string, digest_date date, created_at timestamp"
ASSIGNMENTS = "item_id string, topic_id string, digest_date date"
DIGESTS = "id string, digest_date date, kind string, content_md string, pushed_at timestamp, archived_at timestamp, push_attempts int, archive_attempts int"
NOTE_DETAILS = "feed_id string, xsec_token string, title string, content string, fetched_at timestamp"
CALENDAR = "item_id string, calendar_id string, external_event_id string, synced_at timestamp"
#: What every parser gives.
FETCHED = "source_id string, url string, title string, content string, author string, published_at timestamp"
KINDS = ["event", "news", "tool", "other", "unclassified"]
