"""Hashes of contents, rows and child lists. The hash function is a parameter: bytes to lower-case hex."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HashFn = Callable[[Column], Column]


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), digits, "0")


def content_hash(df: DataFrame, col: str, out: str = "content_hash", hash_fn: HashFn = sha256_hex) -> DataFrame:
    """H1. Hash of a text's UTF-8 bytes, or of binary content."""
    return df.withColumn(out, hash_fn(F.col(col).cast("binary")))


def file_node(kind: Column, content: Column, size: Column, mtime_ns: Column, mode: Column, hash_fn: HashFn = sha256_hex) -> Column:
    """H3. Of one byte kind, the content hash, and size, mtime and mode as big-endian numbers."""
    return hash_fn(F.unhex(F.concat(_hex(kind, 2), content, _hex(size, 16), _hex(mtime_ns, 16), _hex(mode, 8))))


def with_file_node(df: DataFrame, out: str = "node", hash_fn: HashFn = sha256_hex) -> DataFrame:
    return df.withColumn(out, file_node(*map(F.col, ("kind", "content_hash", "size", "mtime_ns", "mode")), hash_fn=hash_fn))


def child_entry(name: Column, kind: Column, child: Column) -> Column:
    """A child's part of its directory's hash, in hex."""
    raw = name.cast("binary")
    return F.concat(_hex(kind, 2), _hex(F.octet_length(raw), 8), F.hex(raw), child)


def list_hash(entries: Column, hash_fn: HashFn = sha256_hex) -> Column:
    """Hash of a list of (name, entry) structs, ordered by name as bytes; an empty or null list hashes nothing."""
    joined = F.array_join(F.transform(F.sort_array(entries), lambda x: x["entry"]), "")
    return hash_fn(F.unhex(F.coalesce(joined, F.lit(""))))


@cache
def _openssl() -> ctypes.CDLL:
    """The library behind hashlib. A bare Python without it raises ImportError."""
    import _hashlib

    lib = ctypes.CDLL(_hashlib.__file__)
    lib.SHA256_Init.argtypes = (ctypes.c_void_p,)
    lib.SHA256_Update.argtypes = (ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t)
    lib.SHA256_Final.argtypes = (ctypes.c_void_p, ctypes.c_void_p)
    return lib


class Sha256:
    """SHA-256 whose state another task can go on from, which hashlib doesn't give: OpenSSL's SHA256_CTX as bytes, alike on
    machines of one byte order."""

    def __init__(self, state: bytes | None = None):
        self._state = ctypes.create_string_buffer(state or bytes(112), 112)
        if state is None:
            _openssl().SHA256_Init(self._state)

    def update(self, address: int, size: int) -> None:
        _openssl().SHA256_Update(self._state, address, size)

    def state(self) -> bytes:
        return self._state.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        _openssl().SHA256_Final(out, ctypes.create_string_buffer(self.state(), 112))
        return out.raw.hex()
