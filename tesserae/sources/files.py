"""Objects that tasks open or create by their keys."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Callable
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs

#: File systems that Python tasks open as Spark does, with no further settings; others are read by Spark's own source.
SCHEMES = ("", "file", "s3", "gs")


def opens(root: str) -> bool:
    return urlsplit(root).scheme in SCHEMES


def is_local(root: str) -> bool:
    return urlsplit(root).scheme in ("", "file")


def numbers(folder: str) -> list[int]:
    """The numbers that name objects of a local folder; none where there is no folder."""
    try:
        with os.scandir(_local(folder)) as found:
            return [int(f.name) for f in found if f.name.isascii() and f.name.isdigit() and (f.name[0] != "0" or f.name == "0") and not f.is_dir()]
    except (FileNotFoundError, NotADirectoryError):
        return []


def _local(uri: str) -> str:
    path = uri.removeprefix("file:")
    return "/" + (path if path.startswith("/") else posixpath.abspath(path)).lstrip("/")


@lru_cache(maxsize=16)
def _store(scheme: str) -> arrow_fs.FileSystem:
    return arrow_fs.LocalFileSystem() if scheme in ("", "file") else arrow_fs.FileSystem.from_uri(f"{scheme}://x")[0]


def open_object(uri: str) -> pa.NativeFile | None:
    """The object, to be read at any place; ``None`` where there is none."""
    local = uri.startswith(("/", "file:")) or urlsplit(uri).scheme == ""  # to split each chunk's name takes longer than to miss it
    try:
        if local:
            path = _local(uri)
            os.stat(path)  # a missing chunk costs less here than below
            return _store("").open_input_file(path)
        parts = urlsplit(uri)
        return _store(parts.scheme).open_input_file(f"{parts.netloc}{parts.path}")
    except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
        return None
    except OSError as e:
        if "is a directory" in str(e).lower() or "not a regular file" in str(e).lower():
            return None
        raise


def creator(folder: str) -> Callable[[str, bytes], None]:
    """Creates objects below ``folder``; one that another attempt of the task has begun or left is replaced in one step."""
    store, root = arrow_fs.FileSystem.from_uri(folder)

    def create(key: str, payload: bytes) -> None:
        path = posixpath.join(root, key)
        try:
            _create_local(path, payload)
        except FileExistsError:
            own = f"{path}.part-{uuid.uuid4().hex}"
            _create_local(own, payload)
            os.replace(own, path)

    def moved(key: str, payload: bytes) -> None:
        path = posixpath.join(root, key)
        store.create_dir(posixpath.dirname(path), recursive=True)
        own = f"{path}.part-{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(payload)
        store.move(own, path)

    return create if isinstance(store, arrow_fs.LocalFileSystem) else moved


def _create_local(path: str, payload: bytes) -> None:
    """One creation and one write; folders are made only where that finds none."""
    how = os.O_WRONLY | os.O_CREAT | os.O_EXCL
    try:
        f = os.open(path, how, 0o666)
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        f = os.open(path, how, 0o666)
    try:
        rest = memoryview(payload)
        while len(rest):
            rest = rest[os.write(f, rest) :]
    finally:
        os.close(f)
