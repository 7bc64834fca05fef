"""Keyed digests, exact 256-bit moduli and the keys made of them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hmac_sha256(key: bytes, message: Column | str) -> Column:
    """HMAC-SHA-256 in lower-case hex: two digests over the padded key, which is worked out on the driver."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(inner, _col(message).cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def span_text_hash(key: bytes, surface: Column | str) -> Column:
    """The hash by which spans carry their surface."""
    return F.concat(F.lit("hmac-sha256:"), hmac_sha256(key, surface))


def hex_mod(digest: Column | str, n: int) -> Column:
    """A 64-digit hexadecimal number modulo ``n`` (below 2**31), folded eight digits at a time."""
    if not 0 < n < 2**31:
        raise ValueError("the modulus must lie between 1 and 2**31 - 1")
    d, base, out = _col(digest), (1 << 32) % n, F.lit(0).cast("long")
    for k in range(8):
        part = F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("long")
        out = (out * F.lit(base) + part) % F.lit(n)
    return out


def record_digest(record_id: Column | str, namespace: str = "docs") -> Column:
    """Digest of namespace and trimmed id."""
    return F.sha2(F.concat(F.lit(f"{namespace}:"), F.trim(_col(record_id).cast("string"))).cast("binary"), 256)


def shard_of(record_id: Column | str, shards: int, namespace: str = "docs") -> Column:
    """Stable shard of a record: its digest modulo the number of shards."""
    return hex_mod(record_digest(record_id, namespace), shards).cast("int")


def set_fingerprint(digest: Column | str) -> Column:
    """An aggregate: a digest of a group's digests whatever their order, combined before any shuffle and never gathered."""
    d = _col(digest)
    number = lambda start, n: F.conv(F.substring(d, start, n), 16, 10).cast("long")
    parts = (F.count("*"), F.bit_xor(number(1, 15)), F.bit_xor(number(16, 15)), F.sum(number(31, 8)))
    return F.sha2(F.concat_ws(":", *(x.cast("string") for x in parts)).cast("binary"), 256)


def surrogate_key(*parts: Column | str) -> Column:
    """A positive 63-bit key: the first eight digest bytes of the parts joined by the unit separator, top bit cleared."""
    digest = F.sha2(F.concat_ws("\x1f", *(_col(p).cast("string") for p in parts)).cast("binary"), 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)
    return high * F.lit(1 << 32) + F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def dedupe_key(*fields: Column | str) -> Column:
    """Digest of length-prefixed, NUL-terminated fields, so that no two field lists share a key."""
    out = []
    for f in fields:
        text = _col(f).cast("string")
        out += [F.octet_length(text).cast("string"), F.lit(":"), text, F.lit("\0")]
    return F.sha2(F.concat(*out).cast("binary"), 256)


def date_shift_days(secret: bytes, key: Column | str, max_days: int) -> Column:
    """Days to shift a subject's dates by: never 0, within ``max_days`` either way, the same for equal keys."""
    bucket = hex_mod(hmac_sha256(secret, _col(key).cast("string")), 2 * max_days)
    return F.when(bucket < max_days, bucket - max_days).otherwise(bucket - max_days + 1).cast("int")


def stable_label_hash(label: Column | str, surface: Column | str, digits: int = 8) -> Column:
    """LABEL_ and the first digits of the surface's digest."""
    return F.concat(_col(label), F.lit("_"), F.substring(F.sha2(_col(surface).cast("binary"), 256), 1, digits))
