"""Identifiers, keys and small scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.text import normalize, strip

#: Fixed value: the URL name space of name-based UUIDs.
_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_arxiv(s: Column) -> Column:
    return _none(F.regexp_extract(s, r"([0-9]{4}\.[0-9]{4,5})", 1))


def parse_pmc(s: Column) -> Column:
    t = strip(s)
    return F.coalesce(F.upper(_none(F.regexp_extract(t, r"(?i)(PMC[0-9]+)", 1))), F.when(t.startswith("pmc:"), F.upper(F.substring(t, 5, 1_000))))


def parse_doi(s: Column) -> Column:
    return F.lower(_none(F.regexp_replace(F.regexp_extract(s, r"(10\.[0-9]{4,9}/[^\s?#]+)", 1), r"[.,;:)\]}]+$", "")))


def route(s: Column) -> Column:
    """struct<scheme, id>: the source an identifier names, in the order arXiv, PMC, DOI, PDF, none."""
    t = strip(s)
    pdf = F.lower(t).rlike(r"^https?://|\.pdf$") | F.lower(t).startswith("pdf:")
    return (
        F.when(parse_arxiv(t).isNotNull(), F.struct(F.lit("arxiv").alias("scheme"), parse_arxiv(t).alias("id")))
        .when(parse_pmc(t).isNotNull(), F.struct(F.lit("pmc").alias("scheme"), parse_pmc(t).alias("id")))
        .when(parse_doi(t).isNotNull(), F.struct(F.lit("doi").alias("scheme"), parse_doi(t).alias("id")))
        .when(pdf, F.struct(F.lit("pdf").alias("scheme"), t.alias("id")))
        .otherwise(F.struct(F.lit("none").alias("scheme"), F.lit(None).cast("string").alias("id")))
    )


def ref_key(c: Column) -> Column:
    """Reference id without brackets and hash, lower case; b12 and ref_12 stay different."""
    return F.regexp_replace(F.lower(strip(c)), r"^[\[\]#]+|[\[\]#]+$", "")


def fetch_key(doi: Column, arxiv: Column, pmc: Column, title: Column, citation: Column) -> Column:
    """What makes two references the same fetch: DOI, arXiv, PMC id, else the citation's normal form."""
    part = lambda label, c: F.concat(F.lit(label), F.lower(strip(_none(c))))
    return F.coalesce(part("doi:", doi), part("arxiv:", arxiv), part("pmc:", pmc), F.concat(F.lit("citation:"), normalize(F.coalesce(_none(title), citation, F.lit("")))))


def uuid5(name: Column) -> Column:
    """Name-based UUID (SHA-1) of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def claim_id(paper_id: Column, sentence_id: Column, kind: Column, text: Column) -> Column:
    return uuid5(F.concat_ws("|", paper_id, sentence_id.cast("string"), kind, normalize(text)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 2) / 3).cast("int"))


def fresh(ingested_at: Column, now: Column, ttl_seconds: int) -> Column:
    """Whether a negative result is still valid; a missing or later time is not."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ingested_at.cast("timestamp"))
    return F.coalesce((age >= 0) & (age < ttl_seconds * 1_000_000), F.lit(False))


def signature(raw: Column, kind: Column, specificity: Column, status: Column) -> Column:
    """What makes two claims equal between runs; missing parts count as empty."""
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (normalize(raw), kind, specificity, status)])


def score_bucket(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "warn").otherwise("danger")


def chain_confidence(depth: Column) -> Column:
    return F.lit(0.85) - F.lit(0.1) * depth.cast("double")


def is_public_address(ip: Column) -> Column:
    """Whether an IPv4 address lies outside the private and reserved ranges."""
    n = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda a, b: a * 256 + F.coalesce(b.try_cast("long"), F.lit(0)))
    #: Reserved ranges as (first address, prefix length).
    blocks = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4), ("240.0.0.0", 4)]
    inside = F.lit(False)
    for first, bits in blocks:
        a, b, c, d = map(int, first.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        inside = inside | n.between(low, low + 2 ** (32 - bits) - 1)
    return ~inside


def is_public_ipv6(ip: Column) -> Column:
    """Whether an IPv6 literal lies in the global unicast range and outside its documentation, tunnel and 6to4 parts."""
    low = F.lower(ip)
    return low.rlike(r"^[23][0-9a-f]{3}:[0-9a-f:]*$") & ~low.rlike(r"^(?:2001:(?:0?db8|0{0,3}[0-9a-f]?[0-9a-f]?|01[0-9a-f]{2}|1[0-9a-f]{2}):|2001::|2002:|3fff:)")


def acceptable_url(url: Column) -> Column:
    """http or https, without credentials, to a plain name or a public address written the usual way.

    A host whose last label does not start with a letter is an address; anything but four decimal parts
    (one integer, hexadecimal, fewer parts) is refused, as are the local host and null or broken URLs.
    """
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    numeric = host.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$")
    named = host.rlike(r"^(?:[\p{L}\p{N}_-]+\.)*\p{L}[\p{L}\p{N}-]*\.?$") & ~host.rlike(r"(?:^|\.)localhost\.?$")
    six = host.rlike(r"^\[.*\]$") & is_public_ipv6(F.regexp_extract(host, r"^\[(.*)\]$", 1))
    ok = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    return F.coalesce(ok & F.when(numeric, is_public_address(host)).otherwise(named | six), F.lit(False))
