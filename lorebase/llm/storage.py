"""Files in shared folders, by URI, from within tasks.

A task writes under a name of its own and returns the name in its rows. Spark
commits those rows with the task, so files of lost or repeated attempts are
never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _split(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


def create(folder: str, suffix: str):
    """(uri, open stream) of a new file in that folder."""
    system, path = _split(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def open_stream(uri: str):
    system, path = _split(uri)
    return system.open_input_stream(path, compression=None)


def open_file(uri: str):
    """For reads at any place."""
    system, path = _split(uri)
    return system.open_input_file(path)
