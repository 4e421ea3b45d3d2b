"""Files that tasks write to, and read from, the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI (or local path), and the path there."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def make_folder(uri: str) -> None:
    system, path = open_fs(uri)
    system.create_dir(path, recursive=True)


def new_name(stem: str, ending: str) -> str:
    """A name of its own for each attempt of a task: only names in the manifest count."""
    return f"{stem}-{uuid.uuid4().hex[:12]}{ending}"
