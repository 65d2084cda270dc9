"""Predicates on fetched pages, failures, resources and jobs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of block pages, and the page length under which the bare word captcha is one.
BLOCK_PHRASES = (
    "unusual traffic", "verify you are a human", "verify you are human", "access denied", "temporarily blocked", "are you a robot",
    "enable javascript and cookies to continue", "/sorry/", "cf-chl-", "data-sitekey",
)
CAPTCHA_BELOW = 8000
BLOCK_ERROR = "Captcha/block detected by heuristic"
#: Status codes and words of failures that another resource may cure.
BAN_CODES = (401, 403, 407, 429)
TRANSIENT_CODES = (500, 502, 503, 504, 520, 521, 522, 523, 524, 525, 526)
SUSPECT_CODES = (413,)
FAILURE_WORDS = (
    "proxy", "tunnel", "timed out", "timeout", "econnreset", "econnrefused", "enotfound", "dns", "net::err", "connection closed",
    "socket hang up", "tls", "handshake",
)
#: Access tier that a type needs, and category that a type belongs to.
ACCESS = {"mobile_shared": "shared", "mobile": "private", "res_static": "private", "dc_static": "private"}
CATEGORIES = {
    "lte": ("mobile", "lte"), "residential_rotating": ("res_rotating", "residential_rotating", "rotating"),
    "residential_static": ("res_static", "residential", "residential_static"), "datacenter": ("dc_static", "datacenter"),
}
TERMINAL = ("done", "failed", "cancelled")
ASSETS = ("image", "media", "font")
RETRY_CODES = (429, 500, 502, 503, 504)


def has_any(text: Column, words) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def is_block_page(html: Column) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    return has_any(low, BLOCK_PHRASES) | (F.contains(low, F.lit("captcha")) & (F.length(low) < CAPTCHA_BELOW))


def fetch_error(html: Column) -> Column:
    return F.when(is_block_page(html), BLOCK_ERROR)


def status_ok(status: Column) -> Column:
    return F.coalesce(status.between(200, 399), F.lit(False))


def should_retry(retryable: Column, attempts: Column, status: Column, max_retries: int = 3, codes=RETRY_CODES) -> Column:
    return F.coalesce(retryable & (attempts <= max_retries) & (status.isNull() | status.isin(*codes)), F.lit(False))


def is_resource_failure(status: Column, error: Column) -> Column:
    by_code = F.coalesce(status.isin(*BAN_CODES, *TRANSIENT_CODES, *SUSPECT_CODES), F.lit(False))
    return by_code | has_any(F.lower(F.coalesce(error, F.lit(""))), FAILURE_WORDS)


def fetch_failure_retryable(stage: Column, http_status: Column, job_status: Column) -> Column:
    """Whether a failed fetch may be tried again: transport errors, server errors, time-outs and lost jobs may, bad requests not."""
    return (
        F.when(stage.isin("connect", "poll_timeout", "empty_result"), True)
        .when(http_status.isNotNull(), (http_status >= 500) | http_status.isin(408, 429))
        .when(job_status.isin("failed", "cancelled"), job_status == "failed")
        .otherwise(False)
    )


def usable(url: Column, status: Column, expired: Column) -> Column:
    return (F.coalesce(url, F.lit("")) != "") & F.coalesce(status == "active", F.lit(False)) & ~F.coalesce(expired, F.lit(False))


def normal_type(kind: Column) -> Column:
    return F.when(kind == "mobile_shared", "mobile").otherwise(kind)


def category(kind: Column) -> Column:
    out = F.lit("residential_static")
    for name, kinds in CATEGORIES.items():
        out = F.when(normal_type(kind).isin(*kinds), name).otherwise(out)
    return out


def access_allowed(kind: Column, access: Column) -> Column:
    """The type's tier equals the resource's; a type without tier passes."""
    need = F.create_map(*[F.lit(x) for kv in ACCESS.items() for x in kv])[kind]
    return need.isNull() | F.coalesce(need == access, F.lit(False))


def geo_matches(country: Column, city: Column, want_country: Column, want_city: Column) -> Column:
    by_city = want_city.isNull() | F.contains(F.lower(F.coalesce(city, F.lit(""))), F.lower(want_city))
    return F.coalesce(F.upper(country) == F.upper(want_country), F.lit(False)) & by_city


def loads_asset(resource_type: Column) -> Column:
    return ~resource_type.isin(*ASSETS)


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*TERMINAL), F.lit(False))


def display_state(error: Column, status: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) != "", "ERR").otherwise(F.coalesce(status.cast("string"), F.lit("—")))


def summary_valid(request_id: Column, took_ms: Column, warnings: Column) -> Column:
    return F.coalesce((F.length(request_id) > 5) & (took_ms >= 0) & warnings.isNotNull(), F.lit(False))


def drop_sentinel(items: Column, sentinel: str) -> Column:
    return F.when(F.contains(F.coalesce(F.get(items, F.lit(0)), F.lit("")), F.lit(sentinel)), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))).otherwise(items)


def parent_timeout(page_ms: Column) -> Column:
    return F.when(page_ms > 0, 2 * page_ms + 30000)


def fan_out(concurrency: Column) -> Column:
    return F.least(F.greatest(4 * concurrency, F.lit(1)), F.lit(20))


def backoff(attempt: Column, jitter: float = 0.0, key: Column | None = None) -> Column:
    """min(30, 2**attempt) seconds, spread by a hash of key so that runs repeat."""
    base = F.least(F.lit(30.0), F.pow(F.lit(2.0), attempt))
    if not jitter:
        return base
    unit = F.pmod(F.xxhash64(key, attempt), F.lit(1_000_000)) / 1e6
    return base * (1 - jitter + 2 * jitter * unit)


def progress(done: Column, total: Column, status: Column, workers: int) -> Column:
    """pct (half up), running and queued of a job."""
    rest = F.greatest(total - done, F.lit(0))
    running = F.when(status == "running", F.least(F.lit(workers), rest)).otherwise(0)
    return F.struct(
        F.when(total > 0, F.floor(100 * done / total + 0.5)).otherwise(0).cast("long").alias("pct"), running.cast("long").alias("running"), (rest - running).cast("long").alias("queued")
    )


def final_status(current: Column, cancel_requested: Column) -> Column:
    return F.when(current.isin("cancelled", "failed"), current).when(cancel_requested, "cancelled").otherwise("done")


def placeholder(url: Column, message: Column) -> Column:
    """The row that stands for a page without result."""
    return F.struct(
        url.alias("url"), F.lit(None).cast("int").alias("status_code"), F.lit(0).cast("long").alias("took_ms"), F.lit(0).alias("retries"), F.array(message).alias("warnings")
    )


def soft_warnings(error: Column, status: Column) -> Column:
    return F.array_compact(F.array(error, F.concat(F.lit("status_code="), status.cast("string"))))


def merged_headers(base: Column, user: Column) -> Column:
    """base with the user's entries on top; the user's Accept-Language in any case replaces the one of base."""
    own = F.exists(F.map_keys(user), lambda k: F.lower(k) == "accept-language")
    kept = F.map_filter(base, lambda k, v: ~((F.lower(k) == "accept-language") & own) & ~F.array_contains(F.map_keys(user), k))
    return F.map_concat(kept, user)


def without_nulls(m: Column) -> Column:
    kept = F.map_filter(m, lambda k, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def short_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.left(F.sha1(key.cast("binary")), F.lit(24)))


def elapsed_ms(start: Column, end: Column) -> Column:
    return ((end - start) * 1000).cast("long")


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def text_lines(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def first_n(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def truncated(message: Column, n: int = 200) -> Column:
    return F.left(message, F.lit(n))


def now_s() -> Column:
    """Seconds since the epoch; every function that needs a clock takes it as a column, so tests can pass their own."""
    return F.unix_micros(F.current_timestamp()) / 1e6


def geo_or_plain(with_geo: Column, plain: Column) -> Column:
    """The answer to the request with a place, else that to the one without; an empty one is none."""
    return F.coalesce(F.nullif(with_geo, F.lit("")), F.nullif(plain, F.lit("")))
