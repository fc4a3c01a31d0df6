"""Citation URLs and the sources they stand for, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outlets by who runs them, hosts of message channels and accounts, paths that aren't sources.
STATE_MEDIA = (
    "tass.ru tass.com ria.ru rt.com lenta.ru iz.ru rg.ru gazeta.ru vesti.ru smotrim.ru 1tv.ru vz.ru kp.ru mk.ru interfax.ru rbc.ru kommersant.ru vedomosti.ru aif.ru "
    "sputniknews.com ukrinform.ua ukrinform.net armyinform.com.ua"
).split()
INDEPENDENT_MEDIA = (
    "meduza.io novayagazeta.eu themoscowtimes.com istories.media kyivindependent.com pravda.com.ua unian.ua unian.net nv.ua hromadske.ua suspilne.media censor.net liga.net rbc.ua "
    "theinsider.ru theins.ru mediazona.ca zona.media bbc.com reuters.com apnews.com nytimes.com washingtonpost.com wsj.com ft.com theguardian.com cnn.com bloomberg.com "
    "radiosvoboda.org rferl.org currenttime.tv dw.com"
).split()
CHANNEL_HOSTS, NO_CHANNELS = ("t.me", "telegram.me"), ("share", "joinchat", "proxy", "iv", "c")
ACCOUNT_HOSTS, NO_ACCOUNTS = ("x.com", "twitter.com", "mobile.twitter.com", "nitter.net"), ("i", "search", "hashtag", "home", "intent", "share")
OWN_HOSTS = ("understandingwar.org", "criticalthreats.org")
GOVERNMENT = r"\.gov(\.[a-z]{2})?$|(^|\.)gov\.[a-z]{2,3}$|kremlin\.ru$|mil\.ru$|mil\.gov\.ua$|mid\.ru$|president\.gov\.ua$|nato\.int$|europa\.eu$|state\.gov$|defense\.gov$"
TRACKING = r"(?i)([?&])(utm_[^=&]*|fbclid[^=&]*|gclid[^=&]*|ref_[^=&]*|si)=[^&#]*"


def clean_url(raw: Column) -> Column:
    """Without obfuscated dots, closing punctuation, tracking parameters and fragment, the host in lower case; null for others."""
    url = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)\s+dot\s+", "."), r"[),.;\]]+$", "")
    url = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), TRACKING, "$1")
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"&{2,}", "&"), r"\?&", "?"), r"[?&]+$", "")
    head = F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?]+)", 1))
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    return F.when(url.rlike(r"(?i)^https?://[^/?\s]+"), F.concat(head, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def source(url: Column) -> Column:
    """struct(key, platform, name, domain) of who is cited: the channel, the account or the outlet; null for none."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    part = lambda i: F.regexp_replace(F.lower(F.coalesce(F.get(parts, i), F.lit(""))), "^@", "")
    channel = F.when(part(0) == "s", part(1)).otherwise(part(0))
    whole = lambda key, platform, name, domain: F.struct(key.alias("key"), platform.alias("platform"), name.alias("name"), domain.alias("domain"))
    kind = F.when(host.rlike(GOVERNMENT), "gov").when(host.isin(STATE_MEDIA), "state_media").when(host.isin(INDEPENDENT_MEDIA), "independent_media").otherwise("other")
    return (
        F.when(host.isNull() | (host == "") | host.isin(*OWN_HOSTS), None)
        .when(host.isin(*CHANNEL_HOSTS), F.when((channel != "") & ~channel.isin(*NO_CHANNELS), whole(F.concat(F.lit("t.me/"), channel), F.lit("telegram"), channel, F.lit("t.me"))))
        .when(host.isin(*ACCOUNT_HOSTS), F.when((part(0) != "") & ~part(0).isin(*NO_ACCOUNTS), whole(F.concat(F.lit("x.com/"), part(0)), F.lit("x"), part(0), F.lit("x.com"))))
        .otherwise(whole(host, kind, host, host))
    )
