"""Binary files in the shared folder, written and read by tasks.

A task writes under a name of its own attempt and reports it; only reported names are read. So a task
that is lost, retried or run twice leaves at most a file that nobody reads.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs) or of a plain local path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])


@contextmanager
def new_file(folder: str, stem: str, suffix: str) -> Iterator[tuple[BinaryIO, str]]:
    """An open file in the folder and its URI."""
    uri = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    system, path = resolve(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        yield out, uri


@contextmanager
def open_file(uri: str) -> Iterator[BinaryIO]:
    system, path = resolve(uri)
    with system.open_input_file(path) as f, io.BufferedReader(f, 1 << 20) as buffered:
        yield buffered
