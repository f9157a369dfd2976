"""Opening the files that tasks write and read, in any store that pyarrow reaches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def create(folder: str, suffix: str):
    """(path, output stream) of a new file. Each attempt of a task writes its own; only those named by the attempt
    that succeeded are ever read."""
    where, at = store(folder)
    where.create_dir(at, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", where.open_output_stream(f"{at}/{name}", compression=None)


def open_input(path: str):
    where, at = store(path)
    return where.open_input_file(at)


def listed(path: str, suffix: str | tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the files with that suffix in a folder, or of the one file, in order of their names."""
    where, at = store(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = where.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f"{path.rstrip('/')}/{x.path[len(at.rstrip('/')) + 1:]}", x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(suffix))


def write_manifest(folder: str, found: Iterable[tuple[str, int]]) -> str:
    """A file that lists (path, bytes) of the files that count; whatever else lies in the folder is never read."""
    path, out = create(folder, ".manifest")
    with out:
        for name, size in found:
            out.write(f"{size}\t{name}\n".encode())
    return path


def read_manifest(path: str) -> list[tuple[str, int]]:
    with open_input(path) as source:
        lines = bytes(source.read()).decode().splitlines()
    return [(name, int(size)) for size, _, name in (x.partition("\t") for x in lines)]
