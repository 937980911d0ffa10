"""Byte files in any store that pyarrow can open, for the operators with formats of their own."""

from __future__ import annotations

import posixpath

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and inner path of ``file:///x``, ``hdfs://…``, ``s3://…`` or a plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Write the parts under a passing name, then move: a file that is there is whole."""
    where, path = store(uri)
    where.create_dir(posixpath.dirname(path), recursive=True)
    size = 0
    with where.open_output_stream(path + ".part") as out:
        for part in parts:
            out.write(part)
            size += len(part)
    where.move(path + ".part", path)
    return size


def open_file(uri: str):
    where, path = store(uri)
    return where.open_input_file(path)


def list_files(uri: str, ending: str) -> list[tuple[str, int]]:
    """Names and sizes of the files directly in a folder, by name."""
    where, path = store(uri)
    found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(ending))
