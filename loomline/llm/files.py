"""Binary files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_file(uri: str, parts) -> int:
    """Writes the byte strings under a name of its own and then moves them to uri, so a repeated task leaves one whole file."""
    system, path = _place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own, size = f"{path}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(own, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(own, path)
    return size


def read_file(uri: str, start: int = 0, length: int | None = None) -> bytes:
    """Bytes of a file; a negative start counts from its end."""
    system, path = _place(uri)
    with system.open_input_file(path) as f:
        f.seek(start if start >= 0 else max(0, f.size() + start))
        return f.read(length) if length is not None else f.read()


class Bundle:
    """A file of byte strings that a task writes one after the other; each attempt of a task has a file of its own."""

    def __init__(self, folder: str):
        self.uri, self.size, self.out = f"{folder}/{uuid.uuid4().hex}", 0, None

    def __enter__(self) -> Bundle:
        return self

    def __exit__(self, *_) -> None:
        if self.out is not None:
            self.out.close()

    def add(self, blob: bytes) -> bytes:
        """Writes blob; gives its address, for fetch()."""
        if self.out is None:
            system, path = _place(self.uri)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.out = system.open_output_stream(path, compression=None)
        self.out.write(blob)
        self.size += len(blob)
        return json.dumps([self.uri, self.size - len(blob), len(blob)]).encode()


def fetch(address: bytes) -> bytes:
    """The byte string at an address of a Bundle, which is closed by then."""
    uri, start, length = json.loads(address)
    return read_file(uri, start, length)
