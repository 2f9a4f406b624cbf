"""Identifiers computed from text, equal on every run and every engine."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE_BITS = (1 << 63) - 1
DEFAULT_BASE = "https://example.com/finance-model/"


def stable_id(name: Column) -> Column:
    """A positive 63-bit id: the first 8 bytes of SHA-256 without the sign bit, never 0."""
    leading = F.substring(F.sha2(name, 256), 1, 16)
    value = F.conv(leading, 16, -10).cast("bigint").bitwiseAND(F.lit(POSITIVE_BITS))
    return F.when(value == 0, F.lit(1).cast("bigint")).otherwise(value)


def stable_uuid(name: Column, base: str = DEFAULT_BASE) -> Column:
    """The version 5 UUID of ``base`` + ``name`` in the URL namespace."""
    namespace = F.unhex(F.lit(uuid.NAMESPACE_URL.hex))
    digest = F.sha1(F.concat(namespace, F.encode(F.concat(F.lit(base), name), "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def period_key(identifier: Column, month: Column, prefix: str | None = None, pattern: str = "yyyyMM") -> Column:
    """``S001-202603``, or with a prefix ``COST-S001-202603``."""
    parts = [identifier, F.date_format(month, pattern)]
    return F.concat_ws("-", *([F.lit(prefix)] if prefix else []), *parts)


def padded(prefix: str, sequence: Column, width: int = 4) -> Column:
    """``INV0001``; longer numbers keep all their digits."""
    return F.format_string(f"{prefix}%0{width}d", sequence)


def cyclic(index: Column, values: list[str]) -> Column:
    """The values in turn, by index."""
    position = F.pmod(index, F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), position)
