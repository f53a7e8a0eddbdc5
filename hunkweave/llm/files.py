"""Files that executors write to and read from the shared folder, by any address pyarrow knows (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@contextmanager
def new_file(path: str):
    """A writable stream; the file has its name only once it is whole, so a lost task leaves none half written."""
    system, at = _at(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as out:
        yield out
    system.move(part, at)


def open_file(path: str):
    system, at = _at(path)
    return system.open_input_stream(at, compression=None)


def read_file(path: str) -> bytes:
    with open_file(path) as f:
        return f.read()


def remove_dir(path: str) -> None:
    system, at = _at(path)
    system.delete_dir(at)
