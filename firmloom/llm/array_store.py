"""Arrays in the shared folder: written by one task attempt, memory-mapped by any worker."""

from __future__ import annotations

import os
import tempfile
import urllib.parse
import uuid

import numpy as np
from pyarrow import fs

_OPEN: dict[tuple[str, str], np.ndarray] = {}


def write_array(folder: str, values: np.ndarray) -> str:
    """Write `values` under a fresh name, which only the finished task passes on."""
    files, base = fs.FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}.bin"
    with files.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(np.ascontiguousarray(values).view(np.uint8).data)
    return name


def make_folder(folder: str) -> None:
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """The array, mapped once per worker. From a remote store it is fetched into a file that
    is unlinked as soon as it is mapped, so nothing stays behind."""
    if (folder, name) not in _OPEN:
        files, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/{name}"
        size = files.get_file_info(path).size
        if not size:
            _OPEN[folder, name] = np.empty(0, np.uint8)
        elif urllib.parse.urlparse(folder).scheme in ("", "file"):
            _OPEN[folder, name] = np.memmap(path, np.uint8, "r")
        else:
            handle, copy = tempfile.mkstemp()
            with os.fdopen(handle, "wb") as out, files.open_input_stream(path, compression=None) as data:
                while block := data.read(8 << 20):
                    out.write(block)
            _OPEN[folder, name] = np.memmap(copy, np.uint8, "r")
            os.unlink(copy)
    return _OPEN[folder, name].view(dtype)


def forget(folder: str) -> None:
    for key in [k for k in _OPEN if k[0] != folder]:
        del _OPEN[key]
