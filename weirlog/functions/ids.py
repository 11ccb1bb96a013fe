"""Identifiers and hashes that Spark has no function for, as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weirlog.shipping import ship

# Alphabets of the encodings.
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
SORT32 = "234567abcdefghijklmnopqrstuvwxyz"
# 64-bit FNV-1a.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = FNV_START
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def base32_decode(text: str) -> bytes | None:
    """24 characters hold 15 bytes; None for other lengths or characters."""
    if len(text) != 24 or any(c not in BASE32 for c in text):
        return None
    n = 0
    for c in text:
        n = n << 5 | BASE32.index(c)
    return n.to_bytes(15, "big")


def base32_encode(data: bytes) -> str:
    n = int.from_bytes(data, "big")
    return "".join(BASE32[n >> 5 * i & 31] for i in reversed(range(len(data) * 8 // 5)))


def base58_decode(text: str) -> bytes | None:
    n = 0
    for c in text:
        i = BASE58.find(c)
        if i < 0:
            return None
        n = n * 58 + i
    zeros = len(text) - len(text.lstrip(BASE58[0]))
    return b"\0" * zeros + n.to_bytes((n.bit_length() + 7) // 8, "big")


def multikey(text: str) -> tuple[str, bytes] | None:
    """Curve and compressed point of a `z` key, with or without `did:key:` before it."""
    text = text.removeprefix("did:key:")
    raw = base58_decode(text[1:]) if text.startswith("z") else None
    if raw is None or len(raw) != 35:
        return None
    curve = {b"\xe7\x01": "k256", b"\x80\x24": "p256"}.get(raw[:2])
    return (curve, raw[2:]) if curve and raw[2] in (2, 3) else None


def tid_micros(tid: str) -> int | None:
    """Microseconds of a 13-character time-sortable id; its lowest 10 bits are the clock's id."""
    if len(tid) != 13 or any(c not in SORT32 for c in tid) or tid[0] > "j":
        return None
    n = 0
    for c in tid:
        n = n << 5 | SORT32.index(c)
    return n >> 10


def tid(micros: int, clock: int = 0) -> str:
    n = micros << 10 | clock
    return "".join(SORT32[n >> 5 * i & 31] for i in reversed(range(13)))


def _batched(kind: str):
    """An Arrow-batched function, with this package at hand on the executors."""
    if session := SparkSession.getActiveSession():
        ship(session)
    return F.pandas_udf(kind)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def fnv1a_of(c: Column) -> Column:
    """64-bit FNV-1a of a string's UTF-8 bytes as two's complement."""

    @_batched("long")
    def hashed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _signed(fnv1a(x.encode()))).astype("Int64")

    return hashed(c)


def did_bytes(c: Column) -> Column:
    @_batched("binary")
    def decoded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: base32_decode(x) if x is not None else None)

    return decoded(c)


def tid_micros_of(c: Column) -> Column:
    @_batched("long")
    def decoded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: tid_micros(x) if x is not None else None).astype("Int64")

    return decoded(c)


def valid_did(c: Column) -> Column:
    """Syntax of a DID given as a parameter, without a UDF."""
    return c.rlike(r"^did:[a-z]+:[A-Za-z0-9._:%-]*[A-Za-z0-9._-]$") & (F.length(c) <= 2048)
