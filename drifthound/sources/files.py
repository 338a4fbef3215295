"""Files of the shared folder, opened inside tasks."""

from __future__ import annotations

from pyarrow import fs


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path there."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
