"""The registry of projects: a JSON file in a folder that the driver can reach, on any of Spark's file systems."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .sources import files


@dataclass(frozen=True)
class Entry:
    id: str
    name: str
    path: str
    settings: files.Settings = field(default_factory=files.Settings)
    counts: dict[str, int] = field(default_factory=dict)  # of the last scan


class Manifest:
    """Projects by id, the first 16 hex digits of the SHA-256 of a path as its file system writes it."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place
        self.entries = {e["id"]: Entry(**{**e, "settings": files.Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in e["settings"].items()})}) for e in json.loads(self._read() or "[]")}

    def _file(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self) -> str:
        fs, path = self._file(self.place)
        return "\n".join(r.value for r in self.spark.read.option("wholetext", "true").text(self.place).collect()) if fs.exists(path) else ""

    def save(self) -> None:
        """Writes a file beside the old one and puts it in its place."""
        fs, path = self._file(self.place)
        _, new = self._file(f"{self.place}.new")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps([asdict(e) for e in self.list()], ensure_ascii=False).encode()))
        stream.close()
        fs.delete(path, False)
        fs.rename(new, path)

    def add(self, path: str, name: str | None = None, settings: files.Settings = files.Settings()) -> Entry:
        import hashlib

        full = files._qualified(self.spark, path)
        e = Entry(hashlib.sha256(full.encode()).hexdigest()[:16], name or full.rstrip("/").rpartition("/")[2], full, settings)
        self.entries[e.id] = e
        return e

    def scanned(self, id: str, stats: DataFrame) -> None:
        """Notes the counts of a scan."""
        self.entries[id] = replace(self.entries[id], counts={r.metric: r.value for r in stats.collect()})

    def list(self) -> list[Entry]:
        return sorted(self.entries.values(), key=lambda e: (e.name, e.id))

    def prune(self) -> list[Entry]:
        """Takes out the projects whose folder is gone; these."""
        gone = [e for e in self.list() if not (at := self._file(e.path))[0].exists(at[1])]
        for e in gone:
            del self.entries[e.id]
        return gone

    def table(self) -> DataFrame:
        """(id, name, path, symbols, dependencies) of the projects."""
        rows = [(e.id, e.name, e.path, e.counts.get("symbols"), e.counts.get("dependencies")) for e in self.list()]
        return self.spark.createDataFrame(rows, "id string, name string, path string, symbols long, dependencies long")
