"""Binary files in the shared folder, written and read by executors.

Every file gets a name of its own; a reader learns the names from a manifest table that Spark commits, so the files
of failed or speculative attempts are never read.  Paths are those of ``pyarrow.fs`` (file, hdfs, s3, gs).
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def create(folder: str, suffix: str):
    """(uri, open output stream) of a new file."""
    where, path = _at(folder)
    where.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", where.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)


def open_input(uri: str):
    """Random access to a file."""
    where, path = _at(uri)
    return where.open_input_file(path)


def open_stream(uri: str):
    """Sequential access to a file, as stored."""
    where, path = _at(uri)
    return where.open_input_stream(path, compression=None, buffer_size=1 << 20)
