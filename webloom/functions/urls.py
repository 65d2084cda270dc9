"""URL algebra as column expressions: canonical form, fingerprint, host, resolution of simple references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
#: What Python's str.strip and str.split take as white space.
SPACES = r"[\s\x1c-\x1f\x85\xa0  -     　]"
DEFAULT_PORTS = {"http": "80", "https": "443"}
#: URLs that are their own canonical form: no capitals, user info or port before the path, and no parameters or fragment after it.
PLAIN = r"^https?://[a-z0-9.\-]+/[!\"$-:<->@-~]*\z"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def authority(url: Column) -> Column:
    """host[:port] without user info."""
    return F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), "^.*@", "")


def host(url: Column) -> Column:
    """Lower-cased host, '' if there is none."""
    return F.lower(F.regexp_replace(authority(url), r":[^:\]]*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def _form_decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.translate(c, "+", " "))


def form_encode(c: Column) -> Column:
    """application/x-www-form-urlencoded with ~ kept and * escaped."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def sorted_query(url: Column) -> Column:
    """Parameters decoded, sorted by (key, value) and encoded again; blank values stay, empty parts go."""
    items = F.filter(F.split(F.regexp_extract(url, QUERY, 1), "&"), lambda x: x != "")
    pair = lambda x: F.struct(
        _form_decode(F.substring_index(x, "=", 1)).alias("k"),
        _form_decode(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
    )
    return F.array_join(F.transform(F.array_sort(F.transform(items, pair)), lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"]))), "&")


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no user info, default port, fragment or empty path; sorted parameters.

    NULL for NULL and for a port that is no number up to 65535. Most URLs of a crawl are plain; one match tells them from the rest."""
    return F.when(url.rlike(PLAIN), url).otherwise(_respelled(url))


def _respelled(url: Column) -> Column:
    """The canonical form of any URL, part by part: some 25 times the work of the match with PLAIN."""
    u = strip(url)
    s, h = scheme(u), host(u)
    port = F.regexp_extract(authority(u), r":([^:\]]*)$", 1)
    bad = ~port.rlike("^[0-9]*$") | (F.length(port) > 9) | (F.coalesce(port.try_cast("int"), F.lit(0)) > 65535)
    number = F.when(port == "", None).otherwise(port.try_cast("int").cast("string"))
    default = F.coalesce(F.when(s == "http", "80").when(s == "https", "443"), F.lit(""))
    shown = F.when(number.isNull() | (number == default), h).otherwise(F.concat(h, F.lit(":"), number))
    p = F.regexp_replace(path(u), r"^((?:.*/)?[^/;]*);$", "$1")
    p = F.when(p == "", "/").otherwise(p)
    q = sorted_query(u)
    whole = F.concat(
        F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""),
        F.when((shown != "") | (s.isin("http", "https") & F.startswith(p, F.lit("//"))), F.concat(F.lit("//"), shown)).otherwise(""),
        p,
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
    )
    return F.when(~bad, whole)


def fingerprint(url: Column) -> Column:
    return F.sha1(canonical(url).cast("binary"))


def registrable(h: Column) -> Column:
    """The last two labels: a deliberately naive registrable domain."""
    return F.substring_index(h, ".", -2)


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def input_url(raw: Column) -> Column:
    """What a person typed as an address: http(s) stays, anything else gets https://."""
    s = strip(F.coalesce(raw, F.lit("")))
    ok = s.rlike(r"(?i)^https?:/{0,2}[^\s/?#]")
    return F.when(s == "", "").when(ok, s).otherwise(F.concat(F.lit("https://"), F.regexp_replace(s, "^/+", "")))


def origin(raw: Column, default: str = "http://localhost:8000") -> Column:
    """scheme://host[:port] without a default port; the default for what has none."""
    s = strip(F.coalesce(F.when(raw != "", raw), F.lit(default)))
    own = F.lower(F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#@\s]+)(?:[/?#]|$)", 1))
    kind = scheme(s)
    shown = F.when(kind == "http", F.regexp_replace(own, ":80$", "")).when(kind == "https", F.regexp_replace(own, ":443$", "")).otherwise(own)
    return F.when(own != "", F.concat(kind, F.lit("://"), shown)).otherwise(default)


def search_url(base: str, query: Column, **more: Column) -> Column:
    """base?q=..., every value form-encoded."""
    out = F.concat(F.lit(base + "?q="), form_encode(query))
    for name, value in more.items():
        out = F.concat(out, F.lit(f"&{name}="), form_encode(value.cast("string")))
    return out


def server_of(url: Column) -> Column:
    """scheme://host:port of a resource; socks5_http counts as socks5; an error if host or port is missing."""
    u = F.regexp_replace(url, "^socks5_http://", "socks5://")
    port = F.regexp_extract(authority(u), r":([0-9]+)$", 1)
    fine = (host(u) != "") & (port != "")
    return F.when(fine, F.concat(scheme(u), F.lit("://"), host(u), F.lit(":"), port)).otherwise(F.raise_error(F.concat(F.lit("no host or port: "), u)))


def inferred_scheme(url: Column) -> Column:
    u = F.lower(url)
    return F.when(F.contains(u, F.lit("socks")), "socks5").when(F.startswith(u, F.lit("https")), "https").otherwise("http")


def credentials(url: Column) -> Column:
    """user, password, server: split at the last @ and the first colon."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-_]*://", "")
    auth = F.when(F.contains(rest, F.lit("@")), F.regexp_extract(rest, "^(.*)@[^@]*$", 1))
    return F.struct(
        F.regexp_extract(auth, "^([^:]*)", 1).alias("user"), F.when(F.contains(auth, F.lit(":")), F.regexp_extract(auth, "^[^:]*:(.*)$", 1)).alias("password"),
        F.regexp_extract(rest, "([^@]*)$", 1).alias("server"),
    )


def cookies_with_defaults(cookies: Column, url: Column) -> Column:
    """Cookies (array of name, value, domain, path) with the URL's host and / where domain or path is missing."""
    fill = lambda c: F.struct(
        c["name"].alias("name"), c["value"].alias("value"), F.coalesce(c["domain"], host(url)).alias("domain"), F.coalesce(c["path"], F.lit("/")).alias("path")
    )
    return F.transform(cookies, fill)


def resolve_rooted(href: Column, base: Column) -> Column:
    """Absolute form of a root-relative or absolute http(s) href, without fragment; NULL for other kinds of references."""
    clean = F.regexp_replace(href, "#.*$", "")
    root = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, AUTHORITY, 1))
    return F.when(clean.rlike("^/(?!/)"), F.concat(root, clean)).when(clean.rlike("^https?://"), clean)
