"""Encrypted snapshot of the vault: AES-GCM per value, with a key derived once per job from a passphrase.

The key is a literal of the plan. Set ``spark.sql.redaction.string.regex`` and keep plans with keys out of logs.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key derivation and payload version.
ITERATIONS = 600_000
SALT_BYTES = 16
KEY_BYTES = 32
VERSION = 2


class WrongPassphrase(ValueError):
    """The snapshot does not open with this passphrase, or its data is corrupted."""


@lru_cache(maxsize=4)
def _derived(passphrase: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, ITERATIONS, 2 * KEY_BYTES)


def derive_key(passphrase: str, salt: bytes) -> bytes:
    return _derived(passphrase, salt)[:KEY_BYTES]


def session_key(session: Column, passphrase: str, salt: bytes) -> Column:
    """HMAC-SHA256 of a session id under a key of its own, in hex: equal sessions can be found and joined, none can be
    read."""
    block = _derived(passphrase, salt)[KEY_BYTES:].ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(session, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def encrypt_vault(vault: DataFrame, passphrase: str, salt: bytes | None = None) -> DataFrame:
    """``v, salt, session_key, payload``: an entry as a whole, encrypted, and :func:`session_key` of its session. Spark
    draws a fresh 12-byte initialisation vector per value and puts it in front of the cipher text."""
    salt = salt or os.urandom(SALT_BYTES)
    key = F.lit(derive_key(passphrase, salt))
    entry = F.to_json(F.struct("session_id", "seq", "original", "placeholder", "type"))
    return vault.select(
        F.lit(VERSION).alias("v"), F.base64(F.lit(salt)).alias("salt"),
        session_key(F.col("session_id"), passphrase, salt).alias("session_key"),
        F.base64(F.aes_encrypt(F.encode(entry, "UTF-8"), key, F.lit("GCM"))).alias("payload"))


def sealed_sessions(encrypted: DataFrame, passphrase: str, sessions: list[str]) -> DataFrame:
    """The rows of a snapshot that belong to the named sessions, without opening the others."""
    salts = [r[0] for r in encrypted.select("salt").distinct().limit(2).collect()]
    keys = [session_key(F.lit(s), passphrase, base64.b64decode(x)) for x in salts for s in sessions]
    return encrypted.filter(F.col("session_key").isin(*keys)) if keys else encrypted.limit(0)


def decrypt_vault(encrypted: DataFrame, passphrase: str) -> DataFrame:
    """The vault back. One snapshot has one salt; a wrong passphrase raises :class:`WrongPassphrase`."""
    from veilframe.operators.mask import VAULT_SCHEMA

    salts = [r[0] for r in encrypted.select("salt").distinct().limit(2).collect()]
    if not salts:
        return encrypted.sparkSession.createDataFrame([], VAULT_SCHEMA)
    if len(salts) > 1:
        raise WrongPassphrase("the rows come from more than one snapshot")
    salt = encrypted.sparkSession.range(1).select(F.unbase64(F.lit(salts[0]))).first()[0]
    key = F.lit(derive_key(passphrase, bytes(salt)))
    opened = encrypted.withColumn("plain", F.try_aes_decrypt(F.unbase64("payload"), key, F.lit("GCM")))
    if opened.filter("plain is null").limit(1).count():
        raise WrongPassphrase("wrong passphrase or corrupted data")
    return opened.select(F.from_json(F.decode("plain", "UTF-8"), VAULT_SCHEMA).alias("e")).select("e.*")


def session_count(vault: DataFrame) -> int:
    """What saving or opening a snapshot reports: its number of sessions."""
    return vault.select("session_id").distinct().count()
