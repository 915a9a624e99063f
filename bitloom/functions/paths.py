"""Path and archive names as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCHIVE_SUFFIX = ".bitloom"


def file_part(path: Column) -> Column:
    """What follows the last slash; the backslash counts only where there is no slash."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", -1)).otherwise(F.substring_index(path, "\\", -1))


def folder_part(path: Column) -> Column:
    """What precedes :func:`file_part`, with its slash."""
    return F.left(path, F.length(path) - F.length(file_part(path)))


def path_kind(path: Column) -> Column:
    """folder-like if it ends with a slash of either kind, else file-like; empty is invalid."""
    return F.when(path == "", "invalid").when(path.rlike(r"[/\\]$"), "folder").otherwise("file")


def archive_name(path: Column, out_folder: Column | None = None) -> Column:
    return F.concat(F.lit("") if out_folder is None else out_folder, file_part(path), F.lit(ARCHIVE_SUFFIX))


def original_name(archive: Column) -> Column:
    """The name without the archive suffix; null for another suffix."""
    name = file_part(archive)
    return F.when(F.endswith(name, F.lit(ARCHIVE_SUFFIX)), F.left(name, F.length(name) - len(ARCHIVE_SUFFIX)))
