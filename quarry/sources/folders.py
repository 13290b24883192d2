"""Folders that Spark wrote, opened by pyarrow in a task."""

from __future__ import annotations

import re

import pyarrow.fs as pafs


def arrow_uri(uri: str) -> str:
    """Hadoop's names of the S3 scheme are one for pyarrow."""
    return re.sub(r"^s3[an]://", "s3://", uri)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it."""
    return pafs.FileSystem.from_uri(arrow_uri(uri))
