"""Files of a hierarchy in any store: a local or shared folder, or a URI (file, s3, s3a, gs, abfss, hdfs).

Executors and driver write through the same class. A file appears under its name only when complete: stores that can rename get a file
of another name first, object stores show an object when its upload ends. Nothing is taken for a relative folder by mistake: an unknown
scheme is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from pathlib import Path
from types import TracebackType

import pyarrow as pa
from pyarrow import fs

#: Written names other stores know under another one.
ALIASES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
#: Stores without renaming.
OBJECT_STORES = ("s3", "gcs", "abfs")
BUFFER = 1 << 16


def absolute(root: str) -> str:
    """``root`` as a URI or an absolute path."""
    scheme, sign, rest = root.partition("://")
    if sign:
        return f"{ALIASES.get(scheme, scheme)}://{rest}"
    if root.startswith("file:/"):
        return "file:///" + root.removeprefix("file:").lstrip("/")
    return str(Path(root).resolve())


class Store:
    """A folder; names are relative to it, with slashes."""

    def __init__(self, root: str) -> None:
        try:
            self.fs, self.root = fs.FileSystem.from_uri(absolute(root))
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
            raise ValueError(f"no store for {root!r}: {e}") from e
        self.renames = self.fs.type_name not in OBJECT_STORES
        self._made: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}" if name else self.root

    def make_folder(self, name: str = "") -> None:
        if self.renames and name not in self._made:
            self.fs.create_dir(self.path(name), recursive=True)
            self._made.add(name)

    def open(self, name: str) -> NewFile:
        return NewFile(self, name)

    def write(self, name: str, pieces: Iterable[bytes]) -> None:
        with self.open(name) as f:
            for p in pieces:
                f.write(p)

    def write_text(self, name: str, text: str) -> None:
        self.write(name, [text.encode()])

    def read(self, name: str) -> bytes | None:
        """A file's contents; None if there is no such file."""
        if self.fs.get_file_info(self.path(name)).type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(self.path(name)) as f:
            return f.read()

    def append_text(self, name: str, text: str) -> None:
        """Add to a file; where a store cannot, it is written anew."""
        self.make_folder(name.rpartition("/")[0])
        try:
            with self.fs.open_append_stream(self.path(name)) as f:
                f.write(text.encode())
        except (pa.ArrowNotImplementedError, NotImplementedError):
            self.write(name, [self.read(name) or b"", text.encode()])


class NewFile:
    """A file being written, under a name of its own until complete, so tasks running twice don't meet."""

    def __init__(self, store: Store, name: str) -> None:
        folder, _, base = name.rpartition("/")
        store.make_folder(folder)
        self.store, self.final = store, store.path(name)
        self.temp = f"{store.path(folder)}/.{base}.{uuid.uuid4().hex}.tmp" if store.renames else self.final
        self.stream = store.fs.open_output_stream(self.temp, buffer_size=BUFFER)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def finish(self) -> None:
        self.stream.close()
        if self.temp != self.final:
            self.store.fs.move(self.temp, self.final)

    def discard(self) -> None:
        """Give the file up. An upload to an object store is left unfinished by aborting it, where the store can, else deleted."""
        abort = getattr(self.stream, "abort", None)
        abort() if abort else self.stream.close()
        if self.store.fs.get_file_info(self.temp).type == fs.FileType.File and (self.temp != self.final or not abort):
            self.store.fs.delete_file(self.temp)

    def __enter__(self) -> NewFile:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.discard() if kind else self.finish()
