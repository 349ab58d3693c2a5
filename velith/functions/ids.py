"""Identities: content hashes, chunk ids and version-5 UUIDs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from velith.functions.text import col


def content_hash(content: Column | str) -> Column:
    """SHA-256 of bytes, or of a text's UTF-8."""
    return F.sha2(col(content).cast("binary"), 256)


def chunk_id(doc_id: Column | str, strategy: Column | str, index: Column | str, text: Column | str) -> Column:
    """doc_strategy_00042_hash16, without the strategy part where that is empty; the hash covers all four, index unpadded."""
    doc, plan, number = col(doc_id).cast("string"), F.coalesce(col(strategy), F.lit("")), col(index)
    digest = F.substring(F.sha1(F.concat_ws("|", doc, plan, number.cast("string"), F.coalesce(col(text), F.lit(""))).cast("binary")), 1, 16)
    return F.concat_ws("_", doc, F.when(plan != "", plan), F.format_string("%05d", number), digest)


def uuid5(name: Column | str, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """RFC 4122 version 5: SHA-1 of namespace and name, version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), col(name).cast("binary")))
    part = lambda start, size: F.substring(digest, start, size)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def point_id(chunk: Column | str, prefix: str = "chunk://") -> Column:
    """Id of a chunk's vector: the version-5 UUID of prefix and chunk id in the URL namespace."""
    return uuid5(F.concat(F.lit(prefix), col(chunk)))
