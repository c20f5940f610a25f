"""URL functions. Five canonical forms exist and are kept apart: their rules differ on purpose."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fold_unicode, trim_space

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "icid")
#: Names that the page fetcher drops beside utm_*.
FETCH_TRACKING = ("fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src")

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query."""
    return F.regexp_extract(url, PARTS, k)


def _recode(text: Column) -> Column:
    """Decode, then encode as forms are: tilde bare, asterisk escaped."""
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_without(query: Column, drop, sort: bool = False) -> Column:
    """Parameters but those for whose lower-case name ``drop`` holds, in order or sorted."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(pairs, lambda p: ~drop(F.lower(F.coalesce(F.try_url_decode(name(p)), name(p)))))
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))
    done = F.transform(kept, lambda p: F.concat(_recode(name(p)), F.lit("="), _recode(value(p))))
    return F.array_join(F.array_sort(done) if sort else done, "&")


def _join(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _bare_path(path: Column) -> Column:
    return F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)


def _tracks(name: Column) -> Column:
    return name.isin(*TRACKING)


def _absolute(url: Column) -> Column:
    return (part(url, 1) != "") & (part(url, 2) != "")


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, url: pd.Series) -> pd.Series:
    """Relative resolution; an unparsable pair gives the URL."""

    def one(b, u):
        try:
            return urljoin(b or "", u) if u is not None else None
        except ValueError:
            return u

    return pd.Series([one(b, u) for b, u in zip(base, url)])


def article_url(url: Column, base: Column | None = None) -> Column:
    """Of extracted articles: resolved, tracking dropped, slash at the end dropped, empty path kept. Blank is null, relative stays as it is."""
    url = F.nullif(trim_space(url), F.lit(""))
    if base is not None:
        url = F.when(_absolute(url), url).otherwise(join_url(base, url))
    made = _join(F.lower(part(url, 1)), F.lower(part(url, 2)), _bare_path(part(url, 3)), query_without(part(url, 4), _tracks))
    return F.when(_absolute(url), made).otherwise(url)


def identity_url(url: Column, exact: bool = False) -> Column:
    """Of duplicate detection: as above after folding, path parameters dropped, empty path is the root."""
    url = F.nullif(fold_unicode(url, exact=exact), F.lit(""))
    path = F.regexp_replace(part(url, 3), r";[^/]*$", "")
    path = F.when(path == "", F.lit("/")).otherwise(_bare_path(path))
    made = _join(F.lower(part(url, 1)), F.lower(part(url, 2)), path, query_without(part(url, 4), _tracks))
    return F.when(_absolute(url), made).otherwise(url)


def fetch_url(url: Column) -> Column:
    """Of the page fetcher: host case kept, default port dropped, query sorted, root path empty."""
    host = F.when(F.lower(part(url, 1)) == "http", F.regexp_replace(part(url, 2), ":80$", "")).otherwise(F.regexp_replace(part(url, 2), ":443$", ""))
    drop = lambda n: n.startswith("utm_") | n.isin(*FETCH_TRACKING)
    return _join(F.lower(part(url, 1)), host, F.regexp_replace(part(url, 3), "/+$", ""), query_without(part(url, 4), drop, sort=True))


def feed_url(url: Column) -> Column:
    """Of feed entries: query untouched, empty path is the root; blank is the empty string."""
    url = F.coalesce(trim_space(url), F.lit(""))
    path = F.when(part(url, 3) == "", F.lit("/")).otherwise(_bare_path(part(url, 3)))
    made = _join(F.lower(part(url, 1)), F.lower(part(url, 2)), path, part(url, 4))
    return F.when(url == "", F.lit("")).when(_absolute(url), made).otherwise(F.regexp_replace(url, "#.*$", ""))


def media_url(url: Column, base: Column) -> Column:
    """Images and videos: resolved, nothing dropped."""
    url = F.nullif(trim_space(url), F.lit(""))
    return F.when(url.isNotNull(), join_url(base, url))


def domain(url: Column, provided: Column | None = None) -> Column:
    given = F.nullif(F.lower(trim_space(provided)), F.lit("")) if provided is not None else F.lit(None).cast("string")
    own = F.substring_index(F.substring_index(F.lower(part(url, 2)), "@", -1), ":", 1)
    return F.regexp_replace(F.coalesce(given, own), r"^www\.", "")


def is_source_url(url: Column) -> Column:
    return F.coalesce(F.lower(part(url, 1)).isin("http", "https") & (part(url, 2) != ""), F.lit(False))
