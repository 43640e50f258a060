"""The graph: symbols, dependencies, imports and file states as DataFrames, and snapshots of them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


@dataclass
class CodeGraph:
    symbols: DataFrame
    dependencies: DataFrame
    imports: DataFrame | None = None
    file_state: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> CodeGraph:
        return cls(*(spark.createDataFrame([], s) for s in (schema.SYMBOLS, schema.DEPENDENCIES, schema.IMPORTS, schema.FILE_STATE)))

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: t for f in fields(self) if (t := getattr(self, f.name)) is not None}

    def save(self, path: str, version: int) -> None:
        """Writes an immutable snapshot. Edges are clustered by their source, so that a walk from a few symbols reads few
        row groups. Tables go to a folder of their own; the mark, written last, names it, so that a crash halfway leaves
        nothing in the way of another try. A version that has its mark stays as it is."""
        at = f"{path}/data/{uuid.uuid4().hex}"
        for name, t in self.tables().items():
            key = {"symbols": "qualified_name", "dependencies": "from_symbol", "imports": "file_path", "file_state": "path"}[name]
            t.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{at}/{name}")
        spark = self.symbols.sparkSession
        spark.createDataFrame([(version, at)], "version int, folder string").coalesce(1).write.parquet(f"{path}/done/{version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> CodeGraph:
        marks = spark.read.schema("version int, folder string").option("recursiveFileLookup", "true").parquet(f"{path}/done")
        mark = marks.where(F.lit(True) if version is None else F.col("version") == version).orderBy(F.desc("version")).first()
        if mark is None:
            raise ValueError(f"no snapshot {version or ''} in {path}")
        read = lambda name, s: spark.read.schema(s).parquet(f"{mark.folder}/{name}")
        return cls(*(read(n, s) for n, s in (("symbols", schema.SYMBOLS), ("dependencies", schema.DEPENDENCIES), ("imports", schema.IMPORTS), ("file_state", schema.FILE_STATE))))

    def scan(self, name: str) -> DataFrame:
        """All rows of a table: symbols by file, line, column and name, edges by file, line, source and target."""
        order = {"symbols": ("file_path", "line", "col", "name"), "dependencies": ("from_file", "from_line", "from_symbol", "to_symbol")}
        t = self.tables()[name]
        return t.orderBy(*order[name]) if name in order else t

    def append(self, dependencies: DataFrame | None = None, imports: DataFrame | None = None) -> CodeGraph:
        """The graph with more edges and imports; rows that it has already are not looked for."""
        more = lambda t, new: t if new is None else new if t is None else t.unionByName(new)
        return CodeGraph(self.symbols, more(self.dependencies, dependencies), more(self.imports, imports), self.file_state)

    def register(self) -> None:
        for name, t in self.tables().items():
            t.createOrReplaceTempView(f"graph_{name}")

    def stats(self) -> DataFrame:
        """(metric, value) of every table."""
        counts = [t.agg(F.lit(n).alias("metric"), F.count(F.lit(1)).alias("value")) for n, t in self.tables().items()]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out


def symbol_id(qualified_name):
    return F.sha2(qualified_name, 256)
