"""Expressions over URLs: host and origin as browsers see them, where a URL is plain enough; what isn't has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, user data, host and port of a URL with an authority.
_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@\\]*@)?([A-Za-z0-9._~%-]+|\[[0-9A-Fa-f:.]+\])(?::([0-9]*))?(?=[/?#\\]|$)"
#: Ports that an origin doesn't name. Fixed values.
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), _AUTHORITY, k)


def host(url: Column) -> Column:
    """The host in lower case, without user data and port; null if there is none."""
    return F.nullif(F.lower(_part(url, 2)), F.lit(""))


def origin(url: Column) -> Column:
    """scheme://host[:port], the port only if it isn't the scheme's own; empty if there is no host."""
    scheme, port = F.lower(_part(url, 1)), _part(url, 3)
    own = F.lit("")
    for s, p in DEFAULT_PORTS.items():
        own = F.when(scheme == s, F.lit(p)).otherwise(own)
    shown = F.when((port != "") & (port != own), F.concat(F.lit(":"), port)).otherwise("")
    return F.coalesce(F.concat(scheme, F.lit("://"), host(url), shown), F.lit(""))


def government_host(host_: Column) -> Column:
    """Whether a host is or ends in .gov or .mil."""
    return F.coalesce(F.lower(host_).rlike("(^|\\.)(gov|mil)$"), F.lit(False))


def government_url(url: Column) -> Column:
    """Whether a URL's host is a government's; false for what isn't a URL."""
    return government_host(host(url))


def safe_url(url: Column) -> Column:
    """Whether a URL is https and a government's."""
    return F.coalesce(url.startswith("https://"), F.lit(False)) & government_url(url)


def off_origin_urls(html: Column, page_origin: Column) -> Column:
    """The http and https URLs of ``src`` attributes whose origin isn't ``page_origin``, in order; links don't count."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?i)\\bsrc\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return F.filter(found, lambda u: u.rlike("^(?i:https?)://") & (origin(u) != page_origin))
