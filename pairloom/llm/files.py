"""Binary files in the shared folder, through pyarrow's file systems."""

from __future__ import annotations

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is local."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def folder(uri: str) -> None:
    fs, path = opened(uri)
    fs.create_dir(path, recursive=True)


class Writer:
    """A new file; it counts only once its name is in a manifest."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.uri, self.stream = uri, fs.open_output_stream(path)

    def write(self, data) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()


def read_range(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)
