"""Binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:/"):
        if uri.startswith("file:/") and not uri.startswith("file:///"):
            uri = "file://" + uri[5:]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def make_folder(uri: str) -> None:
    system, path = _place(uri)
    system.create_dir(path, recursive=True)


def put(folder: str, name: str, parts: list[bytes]) -> str:
    """Write a file and return its address.

    The name holds a random part, so a task that runs twice never writes over
    the file that another attempt has reported.
    """
    address = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    system, path = _place(address)
    with system.open_output_stream(path) as out:
        for p in parts:
            out.write(p)
    return address


def get(address: str) -> bytes:
    system, path = _place(address)
    with system.open_input_file(path) as f:
        return f.read()


def open_stream(address: str):
    system, path = _place(address)
    return system.open_input_stream(path)


def open_sink(folder: str, name: str):
    """(address, stream) of a new file."""
    address = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    system, path = _place(address)
    return address, system.open_output_stream(path)
