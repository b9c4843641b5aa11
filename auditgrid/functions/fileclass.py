"""What kind of file a row is: server only, client, public route; and names of keys and escapers."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditgrid.functions.text import js_trim, lines, matches

# Paths, names and words that decide a file's class.
SERVER_ONLY_IMPORT = r"""(?:import\s+['"]server-only['"]|require\(\s*['"]server-only['"]\s*\))"""
SERVER_PATH = r"(?:(?:^|\/)(?:app|pages)\/api\/|(?:^|\/)api\/|(?:^|\/)server\/|\.server\.[mc]?[jt]sx?$|(?:^|\/)route\.[mc]?[jt]sx?$|(?:^|\/)middleware\.[mc]?[jt]sx?$|\.(?:server-action|actions)\.[mc]?[jt]sx?$)"
CLIENT_DIR = r"(?:^|\/)(?:components|hooks)\/"
CLIENT_EXT = r"\.(?:html|vue|svelte)$"
ESCAPERS = ("esc", "escape", "escapeHtml", "escapeHTML", "htmlEscape", "sanitize", "sanitizeHtml", "sanitizeHTML", "DOMPurify", "dompurify", "purify", "xss", "encodeURI", "encodeURIComponent", "textContent")
PUBLIC_KEY = r"PUBLISHABLE|MAPBOX|POSTHOG|GOOGLE_?MAPS|MAPS_API_KEY|RECAPTCHA_SITE|HCAPTCHA_SITE|TURNSTILE_SITE|ANON_KEY|SUPABASE_ANON|ALGOLIA_(?:APP|SEARCH)|SENTRY_DSN|MEASUREMENT_ID|MIXPANEL|AMPLITUDE|SEGMENT_WRITE|GA_TRACKING|GTAG"
SECRET_KEY = r"SECRET|PRIVATE|SERVICE_ROLE|SERVICE_KEY|PASSWORD|PASSWD|ADMIN_KEY|MASTER_KEY|DATABASE_URL|DB_PASSWORD"
PUBLIC_ROUTE = r"(?:^|\/)(?:manifest|sitemap|robots|rss|feed|og|opengraph|icon|favicon|health|healthz|ping|status|version|webhooks?)(?:[.-][\w.-]*)?(?:\/|$)|\/public\/"
DIRECTIVE_LINES = 25


def has_directive(content: Column, directive: str) -> Column:
    """Whether a directive stands before the first statement, in the first lines."""
    head = F.transform(F.slice(lines(content), 1, DIRECTIVE_LINES), js_trim)
    code = F.filter(head, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("/*") & ~x.startswith("*"))
    # Directives up to the first line that is none.
    state = F.aggregate(
        code,
        F.lit(0),
        lambda a, x: F.when(a != 0, a).when(matches(x, rf"""^['"]{directive}['"];?$"""), 1).when(matches(x, r"""^['"][^'"]+['"];?$"""), 0).otherwise(2),
    )
    return state == 1


def is_server_only(path: Column, content: Column) -> Column:
    return matches(content, SERVER_ONLY_IMPORT) | matches(path, SERVER_PATH, "i") | has_directive(content, "use server")


def is_client(path: Column, content: Column) -> Column:
    return has_directive(content, "use client") | (~is_server_only(path, content) & (matches(path, CLIENT_EXT, "i") | matches(path, CLIENT_DIR, "i")))


def designed_public(name: Column) -> Column:
    """Keys that are made to be seen, by their names."""
    return matches(name, PUBLIC_KEY, "i") & ~matches(name, SECRET_KEY, "i")


def escaper_pattern(custom: Iterable[str] = ()) -> str:
    names = "|".join(re.escape(x) for x in (*ESCAPERS, *custom))
    return rf"(?:{names})\s*[.(]"
