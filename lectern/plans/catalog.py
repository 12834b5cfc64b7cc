"""Versioned tables: every change is a new snapshot, and one swap of the manifest commits all of a step's tables.

Readers pin a manifest when they open the catalog, so they see one state however long they read; only ``WriteCatalog``
has methods that change it. A single writer (the driver) commits. Everything lies in one folder of any file system that
driver and executors share.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.files import Folder

FORMAT = 1


class Conflict(RuntimeError):
    """Another commit came between."""


class ReadCatalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        self.manifest = self._load()

    def _load(self) -> dict:
        found = self.folder.read("manifest.json") if self.folder.exists("manifest.json") else {"format": FORMAT, "version": 0, "tables": {}, "meta": {}, "events": 0}
        if found["format"] != FORMAT:
            raise RuntimeError(f"the catalog has format {found['format']}, this code reads {FORMAT}")
        return found

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.folder.at(self.manifest["tables"][name]))

    def __contains__(self, name: str) -> bool:
        return name in self.manifest["tables"]

    def meta(self, key: str) -> str | None:
        return self.manifest["meta"].get(key)


class WriteCatalog(ReadCatalog):
    def commit(self, tables: dict[str, DataFrame] | None = None, meta: dict[str, str | None] | None = None, events: DataFrame | None = None) -> int:
        """Write the new snapshots, then make them and the events visible at once."""
        paths = {}
        for name, df in (tables or {}).items():
            paths[name] = f"{name}/v-{uuid.uuid4().hex}"
            df.write.parquet(self.folder.at(paths[name]))
        at = self.manifest["events"] + 1
        if events is not None:  # numbered within the commit; readers follow the directory
            self.folder.remove(f"events-staged/{at:012d}")  # of a commit that died
            events.coalesce(1).write.parquet(self.folder.at(f"events-staged/{at:012d}"))
        now = self._load()
        if now["version"] != self.manifest["version"]:
            raise Conflict(f"version {now['version']} was committed since {self.manifest['version']}")
        new = json.loads(json.dumps(now))
        new["tables"] |= paths
        for k, v in (meta or {}).items():
            if v is None:
                new["meta"].pop(k, None)
            else:
                new["meta"][k] = v
        new["version"] += 1
        new["events"] += events is not None
        self.folder.replace("manifest.json", new)
        self.manifest = new
        self.publish()
        return new["version"]

    def publish(self) -> None:
        """Move staged events of committed steps to where streams read them; after a crash the next commit does it."""
        for step in self.folder.names("events-staged"):
            if int(step) <= self.manifest["events"]:
                for f in self.folder.names(f"events-staged/{step}"):
                    if f.endswith(".parquet"):
                        self.folder.move(f"events-staged/{step}/{f}", f"events/{step}-{f}")
                self.folder.remove(f"events-staged/{step}")

    def register_model(self, key: str, model: str) -> None:
        """The first model that fills a vector set is its model; another one is refused."""
        have = self.meta(key)
        if have is None:
            self.commit(meta={key: model})
        elif have != model:
            raise RuntimeError(f"{key} holds vectors of {have}, not of {model}")
