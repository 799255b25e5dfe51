"""Whole files in shared storage, written and read by tasks through the path's own file system."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_whole(uri: str, data: bytes) -> None:
    """Write under a passing name and move: a lost or repeated attempt leaves no half file."""
    system, path = _at(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    passing = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(passing, compression=None) as out:
        out.write(data)
    system.move(passing, path)


def read_whole(uri: str) -> bytes:
    system, path = _at(uri)
    with system.open_input_stream(path, compression=None) as file:
        return file.read()


def exists(uri: str) -> bool:
    system, path = _at(uri)
    return system.get_file_info(path).type == fs.FileType.File
