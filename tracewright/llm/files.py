"""Files in the shared store, from tasks: whole writes that appear at once, and ranged reads."""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def put(folder: str, name: str, parts: list[bytes]) -> str:
    """Write parts as one file, under a name that no other attempt of the task uses; returns its URI."""
    store, path = resolve(folder)
    store.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{path}/.{name}") as out:
        for part in parts:
            out.write(part)
    store.move(f"{path}/.{name}", f"{path}/{name}")
    return f"{folder}/{name}"


class Ranged:
    """Bytes of a stored file by offset."""

    def __init__(self, uri: str):
        store, path = resolve(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()
