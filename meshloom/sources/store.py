"""Files of a store that all machines share, by URI: listing, ranges, replacement of whole files. Used in tasks and at planning."""
from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator
from fnmatch import fnmatch

import numpy as np
import pyarrow.fs as pafs

CHUNK = 1 << 20


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; a path without a scheme is a local one (on a cluster: a shared mount)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + re.sub(r"^file:/*", "", uri)
    return (pafs.LocalFileSystem(), uri) if "://" not in uri else pafs.FileSystem.from_uri(uri)


def files_below(uri: str, pattern: str = "*") -> list[tuple[str, int]]:
    """path relative to the URI and size of the files below it whose relative path fits the pattern, in order."""
    fs, root = opened(uri)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    at = len(root.rstrip("/")) + 1
    return sorted((f.path[at:], f.size) for f in found if f.type == pafs.FileType.File and fnmatch(f.path[at:], pattern))


def exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def chunks(fs: pafs.FileSystem, path: str, begin: int = 0, end: int | None = None, size: int = CHUNK) -> Iterator[bytes]:
    with fs.open_input_file(path) as f:
        stop = f.size() if end is None else end
        f.seek(begin)
        while begin < stop:
            part = f.read(min(size, stop - begin))
            if not part:
                return
            begin += len(part)
            yield part


def copy(fs: pafs.FileSystem, source: str, target: str) -> tuple[str, int]:
    """Copy a file piece by piece; the SHA-256 and length of what was copied."""
    digest, n = hashlib.sha256(), 0
    with fs.open_output_stream(target) as out:
        for part in chunks(fs, source):
            digest.update(part)
            out.write(part)
            n += len(part)
    return digest.hexdigest(), n


def sha256(fs: pafs.FileSystem, path: str) -> str:
    digest = hashlib.sha256()
    for part in chunks(fs, path):
        digest.update(part)
    return digest.hexdigest()


def sweep(uri: str, job: str) -> None:
    """Delete what tasks of a job wrote under names of its own and nobody took over (of killed and repeated tasks)."""
    fs, root = opened(uri)
    for name, _ in files_below(uri, f"*.{job}.*"):
        fs.delete_file(f"{root}/{name}")


def drop_folder(fs: pafs.FileSystem, path: str) -> None:
    if exists(fs, path):
        fs.delete_dir(path)


class Spool:
    """A field's values in a temporary file of the task, as doubles."""

    def __init__(self):
        self.f, self.held, self.width = tempfile.TemporaryFile(), [], None

    def add(self, value) -> None:
        row = [value] if not isinstance(value, (list, tuple)) else list(value)
        if self.width not in (None, len(row)):
            raise ValueError(f"rows of {self.width} and {len(row)} components")
        self.width = len(row)
        self.held.extend(np.nan if v is None else v for v in row)
        if len(self.held) >= 1 << 16:
            self.flush()

    def flush(self) -> None:
        self.f.write(np.array(self.held, "<f8").tobytes())
        self.held = []

    def rows(self, lo: int, hi: int) -> bytes:
        self.flush()
        self.f.seek(lo * 8 * self.width)
        return self.f.read((hi - lo) * 8 * self.width)
