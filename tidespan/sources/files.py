"""Files on the local disk or on a store that pyarrow knows, for what Spark has no reader of."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import NativeFile
from pyarrow import fs as stores


def resolve(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a path or URI, and the path on it."""
    if path.startswith("file:"):
        return stores.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return stores.FileSystem.from_uri(path)
    return stores.LocalFileSystem(), os.path.abspath(path)


def _uri(path: str, on_store: str) -> str:
    """The way to ``on_store`` from anywhere, in the terms of ``path``."""
    return on_store if "://" not in path else f"{path.split('://')[0]}://{on_store}" if not path.startswith(("hdfs", "file")) else f"{'/'.join(path.split('/')[:3])}{on_store}"


def list_files(path: str, suffix: str) -> list[tuple[str, int]]:
    """The file at ``path``, or the files with ``suffix`` in that folder, and their sizes."""
    store, place = resolve(path)
    info = store.get_file_info(place)
    if info.type == stores.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == stores.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(stores.FileSelector(place))
    return sorted((_uri(path, x.path), x.size) for x in found if x.type == stores.FileType.File and x.base_name.endswith(suffix))


def has_files(path: str, suffix: str) -> bool:
    """Whether the folder is there and has files with ``suffix``."""
    try:
        return bool(list_files(path, suffix))
    except FileNotFoundError:
        return False


def open_file(path: str) -> NativeFile:
    store, place = resolve(path)
    return store.open_input_file(place)


@contextmanager
def replacing_file(folder: str, name: str, attempt: str) -> Iterator[NativeFile]:
    """A file to write that takes its place in ``folder`` when it is complete."""
    store, place = resolve(folder)
    store.create_dir(place, recursive=True)
    draft = f"{place}/_{name}.{attempt}"
    with store.open_output_stream(draft) as out:
        yield out
    store.move(draft, f"{place}/{name}")
