"""Explicit schemas of the engine's tables and nested records."""

from __future__ import annotations

METADATA = (
    "struct<title:string,description:string,keywords:array<string>,author:string,canonical_url:string,language:string,og_title:string,"
    "og_description:string,og_image:string,og_type:string,twitter_card:string,robots:string>"
)
LINK = "struct<url:string,text:string,is_internal:boolean,nofollow:boolean,link_type:string>"
IMAGE = "struct<src:string,alt:string,title:string>"
PARSED_PAGE = (
    f"url string, metadata {METADATA}, text_content string, links array<{LINK}>, structured_data array<string>, "
    f"headings map<string,array<string>>, images array<{IMAGE}>"
)
#: One line of a session's content file.
CONTENT = (
    "url string, crawled_at timestamp, title string, description string, text string, links_count int, depth int, html string, _corrupt_record string"
)
SITEMAP_ENTRY = "sitemap_url string, kind string, loc string, lastmod string, changefreq string, priority double"
SESSION = "id long, seed_url string, started_at timestamp, completed_at timestamp, status string, pages_crawled long, pages_failed long"
URL_RECORD = (
    "id long, session_id long, url string, status string, http_status int, content_type string, depth int, parent_url string, crawled_at timestamp, error string"
)
SCHEDULE = (
    "id long, name string, url string, schedule_type string, cron_expression string, interval_seconds long, run_at timestamp, max_pages int, max_depth int, "
    "status string, created_at timestamp, last_run timestamp, run_count long"
)
SCHEDULE_RUN = "id long, schedule_id long, started_at timestamp, completed_at timestamp, status string, pages_crawled long, pages_failed long, error string"
MONITORED = "id long, url string, name string, check_interval_hours int, last_checked timestamp, is_active boolean, created_at timestamp"
