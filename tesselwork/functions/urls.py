"""Places of virtual chunks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _resolved(path: Column) -> Column:
    """A path without . and .. segments, which never lead above its root."""
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        plain = F.regexp_replace(F.lower(part), "%2e", ".")
        return F.when(plain == ".", done).when(plain == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(F.regexp_replace(path, "^/", ""), "/"), none, step), "/"))


def location(url: Column) -> Column:
    """A place as it is stored, null if it is none: the scheme lowered; a file's path without dot
    segments, an object's key as it stands, since stores tell a//b and a/../b from others."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.substring(url, F.length(scheme) + 4, F.length(url))
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.substring(rest, F.length(authority) + 1, F.length(rest))
    file = F.concat(F.lit("file://"), authority, _resolved(path))
    return F.when(scheme == "", None).when(scheme == "file", file).when(authority != "", F.concat(scheme, F.lit("://"), rest))


def object_key(url: Column) -> Column:
    """The key within its bucket: the path without query and fragment, percent escapes decoded."""
    raw = F.regexp_extract(url, r"^[^:/]+://[^/?#]*/?([^?#]*)", 1)
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def bucket(url: Column) -> Column:
    """Scheme and host, with the port if there is one; null without a host."""
    found = F.regexp_extract(url, r"^([^:/]+://[^/?#]+)", 1)
    return F.when(found != "", found)


def bare_etag(etag: Column) -> Column:
    return F.btrim(etag, F.lit('"'))
