"""Files in the shared folder, read and written inside tasks by their URI."""

from __future__ import annotations

import re
from uuid import uuid4

from pyarrow import fs


def opened(uri: str):
    """(file system, path) of a URI or of a path without scheme."""
    if re.match(r"\w+:", uri):
        # Hadoop writes file:/a for file:///a
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def publish(folder: str, name: str, write) -> str:
    """Write a file by ``write(stream)`` under a passing name, then give it its own.

    A task that is repeated, or runs twice at once, leaves one whole file.
    """
    system, base = opened(folder)
    system.create_dir(base, recursive=True)
    passing = f"{base}/.{name}-{uuid4().hex}"
    with system.open_output_stream(passing, compression=None) as stream:
        write(stream)
    system.move(passing, f"{base}/{name}")
    return f"{folder}/{name}"
