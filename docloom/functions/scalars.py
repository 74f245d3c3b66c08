"""Column functions of the document engine."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that full-text search leaves out.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with"]
SHORTEST = 3
#: Fixed value: rounds of key derivation.
KEY_ROUNDS = 100_000
#: Fixed value: keeps the cosine of zero vectors finite.
EPSILON = 1e-10


TOKEN = rf"(?U)\w{{{SHORTEST},}}"


def tokens(text: Column) -> Column:
    """Lower-case words of at least 3 characters without stop words, in order, repeats kept.

    Stop words go after the pattern: word boundaries and a look ahead took longer than a lambda over the words.
    """
    long = [w for w in STOP_WORDS if len(w) >= SHORTEST]
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(long))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """In double precision; null if a vector or an element is null or the lengths differ."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(EPSILON))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def letter_embedding(text: Column, dims: int = 128) -> Column:
    """A toy embedding: codes of the first ``dims`` characters over 255, padded with 0, at unit length."""
    codes = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: F.when(i <= F.length(text), F.ascii(F.substring(text, i, F.lit(1))) / F.lit(255.0)).otherwise(F.lit(0.0)))
    return normalise(codes)


def contains_ci(column: Column, needle: str) -> Column:
    return F.coalesce(F.lower(column).contains(needle.lower()), F.lit(False))


def half_even(column: Column, digits: int) -> Column:
    """Rounding to even, as Python's ``round``."""
    return F.bround(column, digits)


def short_id(*natural_key: Column) -> Column:
    """A reproducible id: 16 hex digits of the sha256 of the key's parts."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in natural_key]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def derive_key(password: str, salt: bytes, iterations: int = KEY_ROUNDS, size: int = 32) -> bytes:
    """A key from a password, on the driver: PBKDF2 with HMAC-SHA256."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, size)


def array_union(a: Column, b: Column) -> Column:
    """Elements of both arrays, each once; a null array counts as empty if the other is there."""
    return F.coalesce(F.array_union(a, b), F.array_distinct(a), F.array_distinct(b))


def encrypt(column: Column, key: bytes) -> Column:
    """AES-GCM: 12 bytes of nonce, ciphertext, 16 bytes of tag. Null stays null."""
    return F.aes_encrypt(column.cast("binary"), F.lit(key), F.lit("GCM"))


def decrypt(column: Column, key: bytes) -> Column:
    return F.aes_decrypt(column, F.lit(key), F.lit("GCM")).cast("string")
