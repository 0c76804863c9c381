"""Shared storage for intermediate tables and model files.

Tables are those of :mod:`quillspark.storage`.  Model files live beside them.  Files in a ``file:`` store are memory-mapped in place; from
any other store they are fetched once per worker into an unlinked spool file.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np

from quillspark.storage import discard, forget_shuffles, shared_folder, written

__all__ = ["discard", "forget_shuffles", "mapped", "put", "shared_folder", "written"]


def _local(uri: str) -> str | None:
    if m := re.match(r"file:(?://)?(/.*)", uri):
        return m[1]
    return uri if uri.startswith("/") else None


def _known(uri: str) -> str:
    """Spark's names of a store, as Arrow names it."""
    return re.sub(r"^s3[an]:", "s3:", uri)


def put(uri: str, *arrays: np.ndarray) -> None:
    """Write the arrays' bytes one after another; a retried task replaces the file whole."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for a in arrays:
                f.write(memoryview(np.ascontiguousarray(a)).cast("B"))
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(_known(uri))
    with store.open_output_stream(path) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())


def mapped(uri: str, dtype: type) -> np.ndarray:
    """A read-only memory map of a file written by :func:`put`."""
    if path := _local(uri):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(_known(uri))
    with tempfile.TemporaryFile() as spool, store.open_input_stream(path) as f:
        while part := f.read(1 << 24):
            spool.write(part)
        spool.flush()
        return np.memmap(spool, dtype=dtype, mode="r") if spool.tell() else np.zeros(0, dtype=dtype)
