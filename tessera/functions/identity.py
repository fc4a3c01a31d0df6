"""Identities of channels and visitors: the first that is known, in strict forms, else null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Campaign names, and names of hosts.
CAMPAIGN = r"^[a-z0-9][a-z0-9._~-]*$"
HOST = r"^(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)*[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"
LONGEST = 100


def campaign(value: Column, longest: int = LONGEST) -> Column:
    """A campaign's name in lower case, or null if it isn't one plain token."""
    v = F.lower(F.trim(value))
    return F.when(v.rlike(CAMPAIGN) & (F.length(v) <= longest), v)


def host(value: Column) -> Column:
    """A host's name in lower case without a last dot, or null if it is more than that."""
    v = F.regexp_replace(F.lower(F.trim(value)), r"\.$", "")
    return F.when((v != "") & ~v.rlike(r"[\s/@:?#]") & v.rlike(HOST), v)


def host_of_url(url: Column) -> Column:
    """The host of an http or https URL without credentials, else null."""
    plain = url.rlike(r"^(?i)https?://[^/?#@]+(?:[/?#].*)?$")
    return F.when(plain, host(F.regexp_extract(url, r"^(?i)https?://([^/?#:]+)", 1)))


def channel(source_id: Column, key: Column, domain: Column, url: Column, adapter: Column) -> Column:
    """Which channel a document is of: the registry's, or by its key, domain or host, and by its adapter only where nothing else is known."""
    known = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    identity = F.coalesce(known(key), known(domain), host_of_url(url))
    return F.coalesce(F.concat(F.lit("id:"), source_id.cast("string")), F.concat(F.lit("unregistered:"), identity), F.concat(F.lit("adapter:"), F.lower(adapter)))
