"""URL and host columns, natively."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-cased network location without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.", "")


def comparable(url: Column) -> Column:
    """For comparing: no scheme, www, query, fragment or trailing slash; the host lower-cased, the path's case kept."""
    bare = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"/+$", "")
    name = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/]*)", 1)), r"^www\.", "")
    return F.concat(name, F.regexp_extract(bare, r"^[^/]*(.*)$", 1))


def store_key(url: Column) -> Column:
    """For keys: lower-cased, no fragment or trailing slash; the query stays."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "#.*$", ""), "/+$", "")


def uid(url: Column) -> Column:
    return F.sha1(store_key(url))


def valid_link(url: Column) -> Column:
    """The link if it is http(s); a bare host gets a scheme; anything else is null."""
    text = F.trim(url)
    return F.when(text.rlike(r"(?i)^https?://[^\s/]+\.[^\s/]+"), text).when(text.rlike(r"(?i)^[a-z0-9-]+(\.[a-z0-9-]+)+(/\S*)?$"), F.concat(F.lit("https://"), text))


def host_in(name: Column, hosts: Sequence[str]) -> Column:
    """The host itself or a subdomain."""
    return reduce(or_, (((name == h) | name.endswith(f".{h}")) for h in hosts), F.lit(False))


def strip_html(html: Column) -> Column:
    """Tags and the commonest character references out, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    #: Character references of plain prose.
    for reference, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(reference), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))
