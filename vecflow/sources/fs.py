"""Filesystem access for executor-side file I/O (local, file:, hdfs:, s3: ...)."""

from __future__ import annotations

import re

_FILE_URI = re.compile(r"^file:(//)?")


def filesystem(path: str):
    """``(pyarrow FileSystem, path inside it)`` for a local path or a URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        local = _FILE_URI.sub("", path)
        return fs.LocalFileSystem(), local if local.startswith("/") else "/" + local
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def uri_prefix(path: str, inner: str) -> str:
    """What to put before a path inside the filesystem to address it again."""
    if path.startswith("file:") or "://" not in path:
        return ""
    scheme_and_host = path[: path.find(inner)] if inner and inner in path else path.split("://", 1)[0] + "://"
    return scheme_and_host
