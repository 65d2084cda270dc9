"""Which discovered URLs belong to a crawl, with the reason for those that don't."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import urls


@dataclass(frozen=True)
class Scope:
    """mode: all, same-domain, subdomains or regex. Patterns are searched in the whole URL; exclude comes first."""

    seed: str
    mode: str = "same-domain"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_depth: int = 3


def in_mode(scope: Scope, host: Column) -> Column:
    seed = urls.host(F.lit(scope.seed))
    domain = urls.registrable(seed)
    if scope.mode == "all":
        return F.lit(True)
    if scope.mode == "same-domain":
        return host == seed
    if scope.mode == "subdomains":
        return (host == seed) | (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))
    return F.lit(scope.mode == "regex" and bool(scope.include))


def _any(url: Column, patterns) -> Column:
    return reduce(or_, [url.rlike(p) for p in patterns], F.lit(False))


def reason(scope: Scope, url: Column, depth: Column) -> Column:
    """The first rule that a URL breaks, NULL if it is in scope."""
    host = urls.host(url)
    out = F.when(depth > scope.max_depth, "max_depth")
    out = out.when(~urls.scheme(url).isin("http", "https"), "scheme").when(host == "", "no_host")
    out = out.when(~in_mode(scope, host), "mode").when(_any(url, scope.exclude), "exclude")
    return out.when(~_any(url, scope.include), "include") if scope.include else out


def allows(scope: Scope, url: Column, depth: Column) -> Column:
    return reason(scope, url, depth).isNull()
