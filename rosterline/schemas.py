"""Schemas of the tables that pass between operators."""

from pyspark.sql import types as T

from rosterline import vocab

SOCIAL_LINKS = T.StructType([T.StructField(n, T.StringType()) for n in vocab.SOCIAL_PATTERNS])

SITES = T.StructType([
    T.StructField("site_ord", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("company_name", T.StringType()),
    T.StructField("inn", T.StringType()),
])

PAGES = T.StructType([
    T.StructField("site_url", T.StringType()),
    T.StructField("page_ord", T.LongType()),
    T.StructField("page_url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("lang", T.StringType()),
])

CONTACT_FIELDS = [
    "company_name", "site_url", "inn", "kpp", "company_email", "position_raw", "position_normalized",
    "full_name", "personal_email", "phone", "phone_raw", "social_links", "source_url", "page_language",
    "scan_date", "status", "comment", "extraction_variant",
]
# place of a contact: every "first wins" rule follows this order
CONTACT_ORDER = ["page_ord", "contact_ord"]

CONTACTS = T.StructType(
    [T.StructField("page_ord", T.LongType()), T.StructField("contact_ord", T.LongType())]
    + [
        T.StructField(
            n,
            SOCIAL_LINKS if n == "social_links" else T.TimestampType() if n == "scan_date" else T.StringType(),
        )
        for n in CONTACT_FIELDS
    ]
)

BLOCKLIST = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.StringType()),
])

# allowed values
TASK_STATUS = ["pending", "running", "paused", "completed", "failed", "cancelled"]
TERMINAL_EVENTS = ["completed", "error", "cancelled"]
FALLBACK_REASONS = ["llm_timeout", "llm_http_error", "token_budget_exhausted", "llm_unavailable"]
