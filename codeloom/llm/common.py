"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut as cut

#: Lower-cases A-Z only, in UTF-8 bytes.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A word: what ``bytes.split()`` gives, which splits at just these six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch, about, that become Python objects at once.
SLICE = 1 << 22
#: Entries of each of a worker's caches, and the longest key that a cache keeps: together they bound its bytes.
KEPT, LONGEST = 1 << 18, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32(doc_id as text) mod ``of``; null where doc_id is."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many marks in front as make it no column's."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE bytes each."""
    rows = max(1, batch.num_rows * SLICE // max(SLICE, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose worker gives what it has freed back to the system when its task ends: idle workers stay, and what
    their allocators keep counts beside the next ones'."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def per_batch(df: DataFrame, schema: str, work: Callable[[dict], Iterator[dict] | dict]) -> DataFrame:
    """mapInArrow with dicts of Python lists in, a slice of a batch each, and dicts of lists or arrays out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            made = work({k: batch.column(k).to_pylist() for k in batch.schema.names})
            for one in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([one[f.name].cast(f.type) if isinstance(one[f.name], pa.Array) else pa.array(one[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(trimmed(run), schema)


def in_one_task(rows: DataFrame, schema: str, learn: Callable[[pa.Table], dict]) -> Row | None:
    """The row that ``learn`` makes of all ``rows``, which their caller bounds, as one Arrow table. It runs in one task of
    an executor: the driver plans for all, and has less memory. None without rows. ``learn`` gives binary columns as
    bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        if held := list(batches):
            made = learn(pa.Table.from_batches(held))
            yield pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) for f in out], schema=out)

    return rows.mapInArrow(trimmed(run), schema).first()


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(LOWER).split() if text else []


def labelled_ids(labels: DataFrame, label: str, of: int, held: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled (doc_id, label) rows outside the held-out fold, in order of a hash of doc_id: never a
    matter of where a row stands. Rows with a null doc_id or label teach nothing; repeated ones teach once; of a document
    with several labels each is learnt."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").distinct()
    return rows.where(remainder(F.col("doc_id"), of) != held).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)


def within(rows: DataFrame, size: Column, bound: int) -> DataFrame:
    """The first of labelled ``rows`` (doc_id, label, ...), in order of a hash of doc_id, whose sizes together stay within
    ``bound``. The rows are as few as ``labelled_ids`` gives."""
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "label").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_held", F.sum(size).over(order)).where(F.col("_held") <= bound).drop("_held")
