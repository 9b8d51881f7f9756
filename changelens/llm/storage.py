"""Files in a shared folder, written by tasks and committed by renaming."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI that all executors can reach."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


@contextmanager
def committed(folder: str, name: str) -> Iterator[pa.NativeFile]:
    """A new file that gets its name when it is complete.

    Tasks that run twice write the same bytes under different temporary names; the
    later one replaces the earlier. What a lost task leaves lies in `_temporary`.
    """
    system, root = filesystem(folder)
    system.create_dir(f"{root}/_temporary", recursive=True)
    temporary = f"{root}/_temporary/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as stream:
        yield stream
    system.move(temporary, f"{root}/{name}")


@contextmanager
def opened(folder: str, name: str) -> Iterator[pa.NativeFile]:
    system, root = filesystem(folder)
    with system.open_input_file(f"{root}/{name}") as stream:
        yield stream
