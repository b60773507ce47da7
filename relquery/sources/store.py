"""Tables that last: Parquet versions in a shared folder, and one manifest that says which version of each counts.

A commit writes new versions of the tables that changed beside the old ones and then moves a
new manifest over the old one, in one rename. Readers see all of a commit or nothing of it; a writer that dies
leaves files that no manifest names (``sweep`` takes them away). All access goes through Hadoop's file
systems, so the folder may lie in any store that Spark reaches. There is one writer at a time: a commit
that finds another one's manifest where it expected its own raises ``Conflict``.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest.json"


class Conflict(RuntimeError):
    """Another session has committed since this one read the manifest."""


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = self._load()

    # ------------------------------------------------------------ files

    def _path(self, *parts: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self) -> Any:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self) -> dict[str, Any]:
        if not self._fs().exists(self._path(MANIFEST)):
            return {"version": 0, "tables": {}, "facts": {}}
        stream = self._fs().open(self._path(MANIFEST))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _save(self, state: dict[str, Any]) -> None:
        draft = self._path(f"_manifest.{uuid.uuid4().hex}")
        stream = self._fs().create(draft)
        try:
            stream.write(json.dumps(state, sort_keys=True).encode())
        finally:
            stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(self._fs().makeQualified(draft), self._fs().makeQualified(self._path(MANIFEST)), options)

    # ------------------------------------------------------------ tables

    def names(self) -> list[str]:
        return sorted(self.state["tables"])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/{self.state['tables'][name]}")

    def commit(self, changed: dict[str, DataFrame], dropped: set[str], facts: dict[str, Any]) -> dict[str, DataFrame]:
        """Writes the changed tables and makes them count, all at once. Returns them as they are read now."""
        before = self._load()
        if before["version"] != self.state["version"]:
            raise Conflict(f"{self.folder} has been changed by another session")
        made = {}
        for name, frame in changed.items():
            made[name] = f"v{before['version'] + 1}-{uuid.uuid4().hex[:8]}"
            frame.write.parquet(f"{self.folder}/{name}/{made[name]}")
        tables = {k: v for k, v in before["tables"].items() if k not in dropped} | made
        state = {"version": before["version"] + 1, "tables": tables, "facts": facts}
        if self._load()["version"] != before["version"]:
            raise Conflict(f"{self.folder} has been changed by another session")
        self._save(state)
        self.state = state
        return {name: self.read(name) for name in made}

    def sweep(self) -> int:
        """Deletes versions that the manifest does not name; returns how many. Not while others read old ones."""
        gone, fs = 0, self._fs()
        for table in fs.listStatus(self._path()):
            if not table.isDirectory():
                continue
            name = table.getPath().getName()
            for version in fs.listStatus(table.getPath()):
                if self.state["tables"].get(name) != version.getPath().getName():
                    gone += bool(fs.delete(version.getPath(), True))
        return gone
