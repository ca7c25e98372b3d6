"""Keys of nodes: hashes of their paths, the same in Python (while shredding) and as Spark expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_key(path: str, algorithm: str = "sha1", size: str = "long"):
    """Key of a path: long and int are the absolute value of the digest's last 8 or 4 bytes as a signed number."""
    if size == "debug":
        return path
    digest = hashlib.new(algorithm, path.encode()).digest()
    if size == "native":
        return digest
    n = 8 if size == "long" else 4
    v = int.from_bytes(digest[-n:], "big", signed=True)
    # The least number has no positive counterpart in its width and stays.
    return v if v == -(1 << (8 * n - 1)) else abs(v)


def key_column(path: Column, algorithm: str = "sha1", size: str = "long") -> Column:
    """node_key as a Spark expression."""
    if size == "debug":
        return path
    digest = {"sha1": F.sha1(path), "md5": F.md5(path), "sha256": F.sha2(path, 256)}[algorithm]
    if size == "native":
        return F.unhex(digest)
    if size == "long":
        v = F.conv(F.right(digest, F.lit(16)), 16, -10).cast("bigint")
        return F.when(v == F.lit(-(1 << 63)), v).otherwise(F.abs(F.when(v != F.lit(-(1 << 63)), v)))
    v = F.conv(F.right(digest, F.lit(8)), 16, 10).cast("bigint")
    v = v - F.when(v >= 1 << 31, 1 << 32).otherwise(0)
    return F.when(v == F.lit(-(1 << 31)), v).otherwise(F.abs(v)).cast("int")
