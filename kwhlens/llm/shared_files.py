"""Binary files in the shared folder, written and read by tasks.

Folders are URIs; pyarrow opens them (local or mounted paths, HDFS, object
stores).  A task writes under a name of its own and moves the finished file to
its final name, so that a retried or doubled task leaves one whole file.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):  # as Hadoop writes it
        uri = "file://" + uri.removeprefix("file:")
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


class AtomicFile:
    """An output stream that appears under ``path`` when closed by a clean ``with`` block."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.system, self.path = system, path
        self.temp = f"{path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.stream = self.system.open_output_stream(self.temp)
        return self.stream

    def __exit__(self, kind, *rest) -> None:
        self.stream.close()
        if kind is None:
            self.system.move(self.temp, self.path)
        else:
            self.system.delete_file(self.temp)


def mapped(system: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A flat binary file as an array: memory-mapped on local and mounted paths, else read."""
    if isinstance(system, fs.LocalFileSystem):
        size = system.get_file_info(path).size
        return np.memmap(path, dtype=dtype, mode="r") if size else np.zeros(0, dtype)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)
