"""Schemas of the three input tables. Every column is nullable."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: column names of the input tables, in their documented order. ------------
PAGES_COLUMNS = (
    "context_campaign_name",
    "received_at",
    "category",
    "is_visual_query",
    "path",
    "referrer",
    "context_library_version",
    "context_page_referrer",
    "context_page_title",
    "search",
    "title",
    "url",
    "context_campaign_medium",
    "domain",
    "original_timestamp",
    "timestamp",
    "context_page_search",
    "context_ip",
    "type",
    "uuid_ts",
    "context_campaign_source",
    "context_library_name",
    "context_page_url",
    "sent_at",
    "anonymous_id",
    "id",
    "context_page_path",
    "context_user_agent",
    "name",
    "tab",
    "user_id",
    "context_locale",
    "context_actions_amplitude_session_id",
    "connector_name",
    "matched_asset_count",
    "type_name",
    "asset_guid",
    "certificate_status",
    "announcement_title",
    "announcement_type",
    "context_protocols_source_id",
    "is_custom",
    "context_campaign_content",
    "asset_connector",
    "asset_type",
    "asset_type_name",
    "total_columns",
    "asset_qualified_name",
    "salesforce_account_id",
    "email",
    "environment",
    "username",
    "session_uuid",
    "date_derived",
)

TRACKS_COLUMNS = (
    "context_page_url",
    "id",
    "received_at",
    "event_text",
    "original_timestamp",
    "timestamp",
    "user_id",
    "anonymous_id",
    "event",
    "context_actions_amplitude_session_id",
    "date_derived",
)

USERS_COLUMNS = (
    "id",
    "email",
    "username",
    "domain",
    "role",
    "license_type",
    "job_role",
    "personas",
    "plan",
    "salesforce_account_id",
    "created_at",
    "tenant_created_at",
    "first_name",
    "last_name",
    "name",
    "display_name",
    "received_at",
    "session_uuid",
)
# --- End of fixed values. ------------------------------------------------------------------

_INSTANTS = {
    "timestamp",
    "received_at",
    "original_timestamp",
    "sent_at",
    "uuid_ts",
    "created_at",
    "tenant_created_at",
}


def _schema(columns: tuple[str, ...]) -> T.StructType:
    types = {"date_derived": T.DateType(), **dict.fromkeys(_INSTANTS, T.TimestampNTZType())}
    return T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in columns])


PAGES = _schema(PAGES_COLUMNS)
TRACKS = _schema(TRACKS_COLUMNS)
USERS = _schema(USERS_COLUMNS)
DOMAINS = _schema(("user_id", "domain"))

#: Columns the reports read. The rest serves the semantic model only and may be absent.
REQUIRED = {
    "domains": {"user_id", "domain"},
    "pages": {
        "user_id",
        "timestamp",
        "domain",
        "name",
        "tab",
        "connector_name",
        "type_name",
        "asset_guid",
        "email",
        "session_uuid",
        "context_actions_amplitude_session_id",
    },
    "tracks": {"user_id", "timestamp", "event_text", "context_actions_amplitude_session_id"},
    "users": {
        "id",
        "email",
        "username",
        "domain",
        "role",
        "license_type",
        "job_role",
        "personas",
        "plan",
        "salesforce_account_id",
        "created_at",
        "tenant_created_at",
        "received_at",
        "session_uuid",
    },
}
