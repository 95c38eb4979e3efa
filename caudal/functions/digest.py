"""Keyed digests from built-in functions."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def key() -> bytes:
    """The key of digests that leave the house: CAUDAL_KEY of the environment; the default is for tests only."""
    return os.environ.get("CAUDAL_KEY", "caudal-demo-key").encode()


def sql_hmac(c: str, key: bytes) -> str:
    """SQL of the same digest."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    pads = [bytes(b ^ x for b in key.ljust(64, b"\0")).hex() for x in (0x5C, 0x36)]
    return f"sha256(unhex('{pads[0]}') || unhex(sha256(unhex('{pads[1]}') || encode({c}))))"


def hmac_sha256(c: Column, key: bytes) -> Column:
    """Hexadecimal HMAC-SHA256 of a text; null for null."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def opaque(c: Column, key: bytes, prefix: str = "", length: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(hmac_sha256(c, key), 1, length))
