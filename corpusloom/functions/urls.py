"""URL algebra as Column expressions.

All of it runs inside whole-stage code generation; only relative references that
need dot-segment or query resolution go through one Arrow function.
"""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def _col(url: Column | str) -> Column:
    return F.col(url) if isinstance(url, str) else url


def _clean(url: Column) -> Column:
    """Leading blanks and control characters, and all tabs and line ends, go."""
    return F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")


def normalize_url(url: Column | str, base: Column | str | None = None) -> Column:
    """Canonical form of an address, null if it is no http(s) address.

    Scheme and host in lower case, default port, fragment and trailing slashes
    removed (an empty path becomes `/`, a path of slashes only vanishes), the
    parameters of the query sorted; with `base`, relative references are resolved
    first.  Null gives null.
    """
    u = _clean(_col(url) if base is None else resolve_url(base, url))
    scheme = F.lower(F.regexp_extract(u, SCHEME, 1))
    host = F.lower(F.regexp_extract(u, NETLOC, 1))
    host = F.when((scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":80$", "")).when(
        (scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":443$", "")
    ).otherwise(host)
    whole = F.regexp_extract(u, PATH, 1)
    params = F.regexp_extract(whole, r"(;[^/]*)$", 1)
    path = F.regexp_replace(whole, r";[^/]*$", "")
    path = F.when(path == "", "/").when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(u, QUERY, 1)
    query = F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&", -1)), "&")))
    params = F.when(params == ";", "").otherwise(params)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, path, params, query))


@F.pandas_udf(StringType())
def _urljoin(base: pd.Series, href: pd.Series) -> pd.Series:
    def join(b, h):
        if b is None or h is None:
            return None
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([join(b, h) for b, h in zip(base, href)], dtype=object)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute address of a reference on a page.  Absolute references and rooted
    ones without dot segments stay in the JVM; null or unusable input gives null."""
    b, h = _col(base), _col(href)
    absolute = h.rlike(r"^https?://[^/?#]+") & ~h.rlike(r"/\.")
    rooted = h.rlike(r"^/[^/]") & ~h.rlike(r"/\.") & b.rlike(NETLOC)
    other = ~(absolute | rooted)
    root = F.concat(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), h)
    return F.when(absolute, h).when(rooted, root).otherwise(_urljoin(F.when(other, b), F.when(other, h)))


def get_domain(url: Column | str) -> Column:
    """Lower-cased host with port; the empty string where there is none."""
    return F.lower(F.regexp_extract(_col(url), NETLOC, 1))


def is_internal(link: Column | str, page: Column | str) -> Column:
    """Whether a link stays on its page's host, port included."""
    return get_domain(link) == get_domain(page)


def robots_path(url: Column | str) -> Column:
    """Path and query that robots rules are matched with: `/` for no path,
    without parameters and fragment."""
    u = _col(url)
    path = F.regexp_replace(F.regexp_extract(u, PATH, 1), r";[^/]*$", "")
    query = F.regexp_extract(u, QUERY, 1)
    return F.concat(F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def default_scheme(url: Column | str) -> Column:
    """Prepends `https://` where an address does not begin with http."""
    u = _col(url)
    return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))


def display_url(url: Column | str, path_chars: int = 30, plain_chars: int = 40) -> Column:
    """Short form for lists: host and a path of at most `path_chars`
    characters; what has no host is cut to `plain_chars`."""
    u = _col(url)
    host, path = get_domain(u), F.regexp_extract(u, PATH, 1)
    short = F.when(F.length(path) > path_chars, F.concat(F.substring(path, 1, path_chars), F.lit("..."))).otherwise(path)
    return F.when(host != "", F.concat(host, short)).otherwise(F.substring(u, 1, plain_chars))
