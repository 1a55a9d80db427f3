"""Field encryption and tokens, on the JVM.

AES-256-GCM frames are base64 of 0x01, nonce (12 bytes), tag (16), ciphertext. Spark's aes_encrypt puts the tag last, so the
parts are sliced anew in a projection of its own: the nonce is random and must be drawn once. Tokens are base64 of
HMAC-SHA256, written out over sha2 with pads that the driver prepares. Null counts as the empty string in both.
"""

from __future__ import annotations

import base64
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import Column as Declared
from ..plans.config import ConfigError

BLOCK, NONCE, TAG = 64, 12, 16


def resolve_key(reference: str) -> bytes:
    """env:NAME holds base64, secrets:/path raw bytes, whose last line feed is dropped."""
    scheme, _, rest = reference.partition(":")
    if scheme == "env" and rest:
        if rest not in os.environ:
            raise ConfigError(f"environment variable {rest} is not set")
        return base64.b64decode(os.environ[rest], validate=True)
    if scheme == "secrets" and rest.startswith("/"):
        return Path(rest).read_bytes().removesuffix(b"\n")
    raise ConfigError("a key must be given as env:NAME or secrets:/absolute/path")


def encryption_key(reference: str) -> bytes:
    key = resolve_key(reference)
    if len(key) != 32:
        raise ConfigError(f"an AES-256 key has 32 bytes, not {len(key)}")
    return key


def token_key(reference: str) -> bytes:
    key = resolve_key(reference)
    if len(key) < 32:
        raise ConfigError(f"an HMAC key has at least 32 bytes, not {len(key)}")
    return key


def hmac_token(value: Column, key: bytes) -> Column:
    if len(key) > BLOCK:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ p for b in key)) for p in (0x36, 0x5C))
    body = F.encode(F.coalesce(value.cast("string"), F.lit("")), "UTF-8")
    return F.base64(F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)))


def sealed(value: Column, key: bytes) -> Column:
    """nonce, ciphertext, tag as one binary value; frame() puts it in order."""
    return F.aes_encrypt(F.encode(F.coalesce(value, F.lit("")), "UTF-8"), F.lit(bytearray(key)), F.lit("GCM"))


def frame(sealed_value: Column) -> Column:
    n = F.octet_length(sealed_value)
    nonce, tag = F.substring(sealed_value, 1, NONCE), F.substr(sealed_value, n - TAG + 1, F.lit(TAG))
    body = F.substr(sealed_value, F.lit(NONCE + 1), n - NONCE - TAG)
    return F.base64(F.concat(F.lit(bytearray(b"\x01")), nonce, tag, body))


def decrypt(framed: Column, key: bytes) -> Column:
    raw = F.unbase64(framed)
    n = F.octet_length(raw)
    nonce, tag = F.substring(raw, 2, NONCE), F.substring(raw, 2 + NONCE, TAG)
    body = F.substr(raw, F.lit(2 + NONCE + TAG), n - 1 - NONCE - TAG)
    return F.decode(F.aes_decrypt(F.concat(nonce, body, tag), F.lit(bytearray(key)), F.lit("GCM")), "UTF-8")


def protect(df: DataFrame, columns: tuple[Declared, ...]) -> DataFrame:
    """Encrypt, then hash, the columns that ask for it. Keys are resolved first, so a missing one fails before any work."""
    seal = {c.dest: encryption_key(c.encrypt.key) for c in columns if c.encrypt}
    token = {c.dest: token_key(c.hash.key) for c in columns if c.hash}
    if seal:
        df = df.withColumns({d: sealed(F.col(f"`{d}`"), k) for d, k in seal.items()})
        df = df.withColumns({d: frame(F.col(f"`{d}`")) for d in seal})
    if token:
        df = df.withColumns({d: hmac_token(F.col(f"`{d}`"), k) for d, k in token.items()})
    return df
