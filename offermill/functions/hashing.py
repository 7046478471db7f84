"""Deterministic ids, content hashes, canonical URLs, JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_sha(c: Column, chars: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, chars)


def listing_id(source: Column, source_deal_id: Column) -> Column:
    return short_sha(F.concat(source, F.lit(":"), source_deal_id), 16)


def content_id(text: Column) -> Column:
    return short_sha(text, 12)


def ip_hash(ip: Column) -> Column:
    return short_sha(ip, 32)


def content_hash(json_text: Column) -> Column:
    """Hash that ignores key order: a variant writes its keys back sorted.  Broken JSON is hashed as it is."""
    return short_sha(F.coalesce(F.to_json(F.try_parse_json(json_text)), json_text), 16)


def row_id(*parts: Column) -> Column:
    """Deterministic BIGINT key in place of an auto-increment column."""
    return F.xxhash64(*parts)


def canonical_url(url: Column) -> Column:
    """Scheme, host and path in lower case, without query, fragment or closing slash."""
    u = F.regexp_replace(F.trim(url), r"[?#][\s\S]*$", "")
    u = F.regexp_replace(u, r";[^/]*$", "")
    return F.lower(F.regexp_replace(u, r"/+$", ""))


def url_fingerprint(url: Column) -> Column:
    return short_sha(canonical_url(url), 16)


def tags_array(tags: Column) -> Column:
    """Tags stored as JSON text -> array."""
    return F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>"))


def strip_fences(reply: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(reply, r"```(?:json)?", ""), r"(?U)\A\s+|\s+\z", "")
