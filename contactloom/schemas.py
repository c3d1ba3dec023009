"""Schemas of the stored table and of what flows towards it."""

from __future__ import annotations
LEADS_DDL = """
id BIGINT, company_name STRING, website STRING, scraped_from_url STRING NOT NULL, canonical_url STRING,
description STRING, phone_numbers ARRAY<STRING>, emails ARRAY<STRING>, addresses ARRAY<STRING>,
social_media_links MAP<STRING, STRING>, industry_tags ARRAY<STRING>, chamber_name STRING, chamber_url STRING,
created_at TIMESTAMP, updated_at TIMESTAMP
"""
LEAD_COLUMNS = (
    "id", "company_name", "website", "scraped_from_url", "canonical_url", "description", "phone_numbers", "emails", "addresses",
    "social_media_links", "industry_tags", "chamber_name", "chamber_url", "created_at", "updated_at",
)
#: columns that a record brings; the others are filled on writing
DATA_COLUMNS = tuple(c for c in LEAD_COLUMNS if c not in ("id", "created_at", "updated_at"))
LISTING_FIELDS = ("name", "website", "phone", "email", "address", "industry")
LISTING_DDL = "STRUCT<" + ", ".join(f"{f}: STRING" for f in LISTING_FIELDS) + ">"
#: what a directory page's extractor answers
ANSWER_DDL = f"navigation_links ARRAY<STRING>, business_listings ARRAY<{LISTING_DDL}>, pagination STRUCT<next_page_url: STRING, has_more: BOOLEAN>"
EXPORT_COLUMNS = tuple(c for c in LEAD_COLUMNS if c != "updated_at")
