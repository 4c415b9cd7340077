"""Text files written by tasks, one for each page, in any filesystem that pyarrow knows.

A task writes a page under a name of its own and moves it into place when it is
whole, so a repeated attempt writes the same page again and none is half there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame


def write_pages(lines: DataFrame, folder: str) -> None:
    """``lines`` (path, place, line) to files: the lines of each path in order of place.

    A page's lines are sorted on their way and streamed to its file, so a page
    of any length takes constant memory; a page is one file and so one task's work."""
    uri = folder if "://" in folder else f"file://{folder}"

    def write(rows: Iterator) -> None:
        system, root = fs.FileSystem.from_uri(uri)
        path = stream = part = None

        def close():
            if stream is not None:
                stream.close()
                system.move(part, f"{root}/{path}")

        for r in rows:
            if r["path"] != path:
                close()
                path, part = r["path"], f"{root}/.{uuid.uuid4().hex}"
                system.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                stream = system.open_output_stream(part)
            stream.write((r["line"] or "").encode() + b"\n")
        close()

    lines.select("path", "place", "line").repartition("path").sortWithinPartitions("path", "place", "line").foreachPartition(write)
