"""Listing, reading and writing of files by path or URI: local and mounted paths, hdfs://, s3://, gs://, abfs:// as Arrow's file systems reach them."""

from __future__ import annotations

import posixpath
import re
from fnmatch import fnmatchcase

from pyarrow import fs as pafs

_SCHEME = re.compile("^([a-z][a-z0-9+.-]*)://")


def _at(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system, the path in it, and what stands before such paths to make them URIs again."""
    path = re.sub("^s3[an]://", "s3://", path)
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    scheme = _SCHEME.match(path)
    if not scheme:
        return pafs.LocalFileSystem(), path, ""
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner, path[: path.index(inner)] if inner in path else scheme[0]


def listed(path: str, pattern: str) -> list[str]:
    """The files of a folder whose names fit the pattern, the one file, or the files that fit a path with wildcards in its last part."""
    system, inner, before = _at(path)
    if system.get_file_info(inner).type == pafs.FileType.Directory:
        folder = inner
    elif any(c in inner for c in "*?["):
        folder, _, pattern = inner.rpartition("/")
    else:
        return [before + inner] if exists(path) else []
    found = system.get_file_info(pafs.FileSelector(folder or "/"))
    return sorted(before + f.path for f in found if f.type == pafs.FileType.File and fnmatchcase(posixpath.basename(f.path), pattern))


def exists(path: str) -> bool:
    system, inner, _ = _at(path)
    return system.get_file_info(inner).type == pafs.FileType.File


def opened(path: str):
    """A stream of the file's bytes."""
    system, inner, _ = _at(path)
    return system.open_input_stream(inner, compression=None)


def read(path: str) -> bytes:
    with opened(path) as f:
        return f.read()


def opened_at(path: str):
    """A file that seeks: only what is read of it is fetched."""
    system, inner, _ = _at(path)
    return system.open_input_file(inner)


def size(path: str) -> int:
    system, inner, _ = _at(path)
    return system.get_file_info(inner).size


def created(path: str):
    """A stream into a new file, and the folders above it."""
    system, inner, _ = _at(path)
    system.create_dir(posixpath.dirname(inner), recursive=True)
    return system.open_output_stream(inner, compression=None)


def deleted(path: str) -> None:
    system, inner, _ = _at(path)
    if exists(path):
        system.delete_file(inner)


def moved(path: str, to: str) -> None:
    system, inner, _ = _at(path)
    system.move(inner, _at(to)[1])
