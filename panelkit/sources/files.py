"""Random access to files from data source tasks, wherever pyarrow's file systems reach: local or mounted paths, hdfs:, s3:, gs:."""

from __future__ import annotations

import re
from fnmatch import fnmatch

import pyarrow.fs as pafs


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^file:/*", path):
        path = "/" + re.sub(r"^file:/*", "", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def found(root: str, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder (or of the one file) whose names fit the pattern, whatever its case, by name."""
    system, path = _system(root)
    prefix = root[: len(root) - len(path)] if "://" in root and root.endswith(path) else ""
    info = system.get_file_info(path)
    files = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=False))
    return sorted((prefix + f.path, f.size) for f in files if f.type == pafs.FileType.File and (len(files) == 1 or fnmatch(f.base_name.lower(), pattern.lower())))


class Opened:
    """A file of which ranges of bytes are read; reading past its end is an error."""

    def __init__(self, path: str) -> None:
        system, inner = _system(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        data = bytes(self.file.read_at(n, at)) if n > 0 else b""
        if len(data) != max(n, 0):
            raise EOFError(f"{n} bytes at {at} of {self.size}")
        return data

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()
