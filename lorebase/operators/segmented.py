"""Tables kept as segments in a folder, with numbered manifests.

The newest manifest names the segments that hold, in order of age; nothing that a
manifest names is ever changed. A version is there once its manifest is, so a
writer that fails leaves files that nobody reads, and of two writers of one
version the second fails.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

#: Segments that are merged at least.
FAN = 4


class Segmented:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _versions(self) -> list[int]:
        folder = self._at("manifest")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """Version, and segments from the oldest to the youngest."""
        versions = self._versions()
        return json.loads(self._text(versions[-1])) if versions else {"version": 0, "segments": []}

    def _text(self, version: int) -> str:
        stream = self._fs.open(self._at("manifest", f"{version:010d}.json"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, before: dict, segments: list[dict], **more) -> None:
        """Fails if another writer has made the same version meanwhile. ``more`` is kept in the manifest."""
        version = before["version"] + 1
        stream = self._fs.create(self._at("manifest", f"{version:010d}.json"), False)
        stream.write(bytearray(json.dumps({"version": version, "segments": segments, **more}).encode()))
        stream.close()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove manifests but the last ``keep`` and the segments that none names. No writer may run meanwhile."""
        versions = self._versions()
        for v in versions[: max(0, len(versions) - keep)]:
            self._fs.delete(self._at("manifest", f"{v:010d}.json"), False)
        named = {x["name"] for v in self._versions() for x in json.loads(self._text(v))["segments"]}
        gone = [n for n in (x.getPath().getName() for x in self._fs.listStatus(self._at())) if n != "manifest" and n not in named]
        for n in gone:
            self._fs.delete(self._at(n), True)
        return gone


def merge_from(sizes: list[int]) -> int | None:
    """The place of the first of the youngest segments that are to be merged, if any: of
    ``FAN`` or more, where the oldest is no larger than the others together."""
    for start in range(len(sizes) - FAN + 1):
        if sizes[start] <= sum(sizes[start + 1 :]):
            return start
    return None
