"""Paths: two scope predicates, the folder of a path, test paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strip_right(scope: str, characters: str) -> str:
    return scope.rstrip(characters)


def scope_like(path: Column, scope: str) -> Column:
    """Scope of searches: a LIKE without regard to ASCII case in which % and _ of the scope are wildcards."""
    return F.lower(path).like(_strip_right(scope, "/").lower().replace("\\", "\\\\") + "/%")


def scope_prefix(path: Column, scope: str) -> Column:
    """Scope of context: a literal prefix, with regard to case; backslashes of the path count as slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/")).startswith(_strip_right(scope, "/\\") + "/")


def root_folder(path: Column) -> Column:
    """First component of a path; a file at the top is its own folder; an empty path is `root`."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    absolute = F.replace(path, F.lit("\\"), F.lit("/")).startswith("/")
    return F.when(absolute, F.lit("/")).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("root")))


def is_test_path(path: Column) -> Column:
    return F.lower(path).contains("test")
