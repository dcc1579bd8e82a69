"""Files in the shared folder, by URI, from executors."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Writes a whole file under its name only when it is complete, so retried and speculative tasks do no harm."""
    store, path = locate(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def get(uri: str, start: int = 0, size: int | None = None) -> bytes:
    """Bytes of a file from ``start`` on; a negative start counts from the end."""
    store, path = locate(uri)
    with store.open_input_file(path) as f:
        start = start + f.size() if start < 0 else start
        return f.read_at(f.size() - start if size is None else size, start)
