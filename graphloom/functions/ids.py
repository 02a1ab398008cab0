"""Identity of nodes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(node_type: Column, file_path: Column, name: Column, line_start: Column) -> Column:
    """SHA-256 of type:path:name:line, in hex."""
    return F.sha2(F.concat_ws(":", node_type, file_path, name, line_start.cast("string")), 256)


def node_id_of(node_type: str, file_path: str, name: str, line_start: int) -> str:
    """The same for plain values, for front ends."""
    return hashlib.sha256(f"{node_type}:{file_path}:{name}:{line_start}".encode()).hexdigest()


def short_id(c: Column) -> Column:
    return F.substring(c, 1, 12)
