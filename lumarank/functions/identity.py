"""Identifiers, hashes and split assignment."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_id(paths: Column) -> Column:
    """``group_`` and 16 hexadecimal digits of the hash over the sorted paths, joined by NUL."""
    return F.concat(F.lit("group_"), F.substring(F.sha2(F.concat_ws("\x00", F.array_sort(paths)), 256), 1, 16))


def library_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 32)


def split_bucket(path: Column) -> Column:
    """0-99 from the first eight hexadecimal digits of the path's hash."""
    return (F.conv(F.substring(F.sha2(path, 256), 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def split_name(path: Column, holdout_percent: int = 20) -> Column:
    return F.when(split_bucket(path) < holdout_percent, "holdout").otherwise("train")


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def model_identity(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def config_key(config: dict[str, Any], keys: tuple[str, ...] | None = None) -> str:
    """Hash of the canonical JSON of a configuration, or of its named parts."""
    own = config if keys is None else {k: config.get(k) for k in keys}
    return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def hash_value(hex16: Column) -> Column:
    """A 64-bit hash from 16 hexadecimal digits."""
    return F.conv(hex16, 16, -10).cast("bigint")


def readable_hash(text: Column) -> Column:
    """The 64-bit value of a hash text, null unless it has exactly 16 hexadecimal digits.

    Letter case, a leading ``0x``, ``x`` or ``#``, blanks and separators don't count.
    """
    bare = F.regexp_replace(F.lower(text), "[\\s\\u00a0\\u3000]+", "")
    bare = F.regexp_replace(bare, "^(0x|\\\\x|x|#)", "")
    bare = F.regexp_replace(bare, "[:\\-_.,;/|]", "")
    return F.when(bare.rlike("^[0-9a-f]{16}$"), hash_value(bare))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_current(size: Column, mtime: Column, stored_size: Column, stored_mtime: Column, strict: bool = False) -> Column:
    """Whether a stored row still describes the file; rows without a fingerprint count unless ``strict``."""
    same = size.eqNullSafe(stored_size) & mtime.eqNullSafe(stored_mtime)
    return same if strict else same | stored_size.isNull() | stored_mtime.isNull()
