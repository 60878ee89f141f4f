"""Schemas of the catalogue tables."""

NEIGHBORHOODS = """
    id BIGINT, name STRING, official_name STRING, description STRING, entertainment_level STRING,
    boundary STRING, is_researched BOOLEAN, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"""

VENUES = """
    id BIGINT, neighborhood_id BIGINT, name STRING, category STRING, address STRING, latitude DOUBLE,
    longitude DOUBLE, website_url STRING, event_page_url STRING, phone STRING, description STRING,
    capacity INT, is_active BOOLEAN, scraper_status STRING, last_scraped_at TIMESTAMP_NTZ,
    events_count INT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"""

GEOCODE_CACHE = """
    id BIGINT, query STRING, latitude DOUBLE, longitude DOUBLE, provider STRING, resolved BOOLEAN,
    created_at TIMESTAMP_NTZ"""

EVENTS = """
    id BIGINT, name STRING, date TIMESTAMP_NTZ, date_end TIMESTAMP_NTZ, time STRING, time_end STRING,
    category STRING, categories ARRAY<STRING>, subcategories ARRAY<STRING>, details STRING,
    origination_url STRING, date_retrieved TIMESTAMP_NTZ, source STRING, cost STRING, age_range STRING,
    is_outdoor STRING, address STRING, venue_name STRING, locality STRING, latitude DOUBLE,
    longitude DOUBLE, neighborhood_id BIGINT, venue_id BIGINT"""

CHAT_THREADS = """
    id STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, total_tokens BIGINT, turn_count INT,
    status STRING, context_summary STRING"""

CHAT_MESSAGES = """
    id BIGINT, thread_id STRING, role STRING, content STRING, token_count INT, tool_calls STRING,
    created_at TIMESTAMP_NTZ"""

AUDIT_LOGS = """
    id BIGINT, thread_id STRING, operation STRING, status STRING, duration_ms DOUBLE, tokens_used INT,
    metadata STRING, error_message STRING, created_at TIMESTAMP_NTZ"""

METRICS = """
    id BIGINT, metric_name STRING, metric_type STRING, value DOUBLE, attributes STRING, unit STRING,
    timestamp TIMESTAMP_NTZ"""

TABLES = {
    "neighborhoods": NEIGHBORHOODS,
    "venues": VENUES,
    "geocode_cache": GEOCODE_CACHE,
    "events": EVENTS,
    "chat_threads": CHAT_THREADS,
    "chat_messages": CHAT_MESSAGES,
    "audit_logs": AUDIT_LOGS,
    "metrics": METRICS,
}

# What a column refers to: the id of a row of another table. A copy follows these, parents first.
REFERENCES = {
    "venues": {"neighborhood_id": "neighborhoods"},
    "events": {"neighborhood_id": "neighborhoods", "venue_id": "venues"},
    "chat_messages": {"thread_id": "chat_threads"},
    "audit_logs": {"thread_id": "chat_threads"},
}
