"""HTML functions: link extraction and rule-driven field extraction (Arrow), and text helpers in the JVM."""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import dom

MAX_CHARS = 10 * 1024 * 1024
#: Schemes of links that lead to no page.
SKIPPED = ("javascript:", "mailto:", "tel:", "sms:", "data:", "file:", "ftp:")
_TOKENS = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)|<(a|base)(?=[\s/>])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
#: A rooted path that joining leaves as it is (no dots, empty steps or parameters), without what joining drops; and the root of a base.
_ROOTED = re.compile(r"(/|(?:/[A-Za-z0-9_~-]+)+)\??(?:#[A-Za-z0-9_~-]*)?")
_ROOT = re.compile(r"https?://[a-z0-9.-]+(?=/|\Z)")
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def links_of(page: str | None, base_url: str | None) -> list[str]:
    """Absolute http(s) targets of <a href> in document order, without fragments, each once; the first <base href> counts."""
    if not page:
        return []
    base, hrefs = None, []
    for m in _TOKENS.finditer(page[:MAX_CHARS]):
        if m[2] and (h := _HREF.search(m[3])):
            value = html_module.unescape(next(g for g in h.groups() if g is not None)).strip()
            if m[2].lower() == "a":
                hrefs.append(value)
            elif base is None and value:
                base = value
    out: dict[str, None] = {}
    try:
        start = urljoin(base_url or "", base) if base else base_url or ""
    except ValueError:
        return []
    root = _ROOT.match(start)
    for h in hrefs:
        if root and (plain := _ROOTED.fullmatch(h)):
            out[root[0] + plain[1]] = None
            continue
        if not h or h.lower().startswith(SKIPPED):
            continue
        try:
            absolute = urldefrag(urljoin(start, h))[0]
        except ValueError:
            continue
        if absolute.startswith(("http://", "https://")):
            out[absolute] = None
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_links(pages: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([links_of(p, b) for p, b in zip(pages, bases, strict=True)], dtype=object)


def quick_links(html: Column) -> Column:
    """hrefs of plain <a href="..."> tags, in the JVM; for pages known to write links that way."""
    return F.array_distinct(F.regexp_extract_all(F.left(html, F.lit(MAX_CHARS)), F.lit('<a href="([^"]*)"'), 1))


@dataclass(frozen=True)
class Field:
    """What to pick: attr is text, html or an attribute's name."""

    selector: str
    attr: str = "text"
    all: bool = False
    required: bool = False


@dataclass(frozen=True)
class Rule:
    fields: tuple[tuple[str, Field], ...]
    type: str = "css"


FIELDS = T.StructType([T.StructField("data", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("warnings", T.ArrayType(T.StringType()))])


def fields_of(page: str | None, rule: Rule, compiled: dict | None = None) -> tuple[dict, list[str]] | None:
    """data: name -> values (None for a missing single value), and warnings; None for empty html."""
    if not page:
        return None
    compiled = compile_rule(rule) if compiled is None else compiled
    root, data, warnings = dom.parse(page), {}, []
    for name, f in rule.fields:
        select = compiled[name]
        if select is None:
            data[name] = [] if f.all else None
            warnings.append(f"field '{name}': invalid selector")
            continue
        found = select(root)
        if not found:
            data[name] = [] if f.all else None
            if f.required:
                warnings.append(f"field '{name}': required selector not found")
            continue
        values = [_pick(x, f.attr) for x in (found if f.all else found[:1])]
        data[name] = values if f.all or values[0] is not None else None
    return data, warnings


def compile_rule(rule: Rule) -> dict:
    out = {}
    for name, f in rule.fields:
        try:
            out[name] = (dom.compile_css if rule.type == "css" else dom.compile_xpath)(f.selector)
        except dom.SelectorError:
            out[name] = None
    return out


def _pick(x, attr: str) -> str | None:
    if isinstance(x, str):  # attribute or text step of an XPath
        return " ".join(x.split())
    if attr == "text":
        return " ".join(x.text().split())
    return x.html() if attr == "html" else x.attrs.get(attr)


def extractor(rule: Rule):
    """An Arrow function html -> struct(data, warnings); selectors are compiled once a task, html is parsed once for all fields."""

    @F.pandas_udf(FIELDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = compile_rule(rule)
        for pages in batches:
            got = [fields_of(p, rule, compiled) or (None, None) for p in pages]
            yield pd.DataFrame({"data": [d for d, _ in got], "warnings": [w for _, w in got]}, dtype=object)

    return run


def extract(html: Column, rule: Rule) -> Column:
    """Struct with one column a field: array<string> for all, else string; and warnings."""
    got = extractor(rule)(html)
    columns = [(got["data"][name] if f.all else F.get(got["data"][name], F.lit(0))).alias(name) for name, f in rule.fields]
    return F.struct(*columns, got["warnings"].alias("warnings"))


def collapse(text: Column) -> Column:
    """All white space (as Python's str.split sees it) becomes single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f\x85\xa0  -     　]+", " "))


def pre_json(body: Column, key: str) -> Column:
    """A key of the JSON that a body holds, plain or inside <pre>; the first comma-separated token of it."""
    inner = F.when(F.startswith(F.ltrim(body), F.lit("<")), F.regexp_extract(body, "(?s)<pre[^>]*>(.*?)</pre>", 1)).otherwise(body)
    return F.trim(F.substring_index(F.get_json_object(inner, f"$.{key}"), ",", 1))


def zip_by_position(driver: Column, **others: Column) -> Column:
    """array<struct<pos, driver, others>>: as long as driver; shorter arrays give NULL."""
    return F.transform(driver, lambda x, i: F.struct(i.alias("pos"), x.alias("item"), *[F.get(c, i).alias(n) for n, c in others.items()]))
