"""Helpers that several operators of this subpackage share.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir`` (shared by the driver and all executors), so a lost
executor costs a re-read and not a recomputation of everything before it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one in local mode (tests) and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


class Tables:
    """The intermediate tables of one run, as Parquet in the shared folder.

    ``drop`` deletes those that nothing reads any more, so a run doesn't leave several times its input behind;
    tables that the result still reads stay.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/auditgrid-{name}-{uuid.uuid4().hex[:12]}"
        self.kept: list[str] = []
        self.n = 0
        if _SCRATCH:
            _SCRATCH[-1].append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}-{name}"
        df.write.parquet(path)
        self.kept.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *but: str) -> None:
        """Delete all tables written so far, but those with the names given."""
        stays = [p for p in self.kept if p.rpartition("-")[2] in but]
        for path in self.kept:
            if path not in stays:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.kept = stays


_SCRATCH: list[list[Tables]] = []


@contextmanager
def scratch() -> Iterator[list[Tables]]:
    """All ``Tables`` that are made inside. The caller, who knows when the last reader is done, hands them to ``drop_all``."""
    _SCRATCH.append([])
    try:
        yield _SCRATCH[-1]
    finally:
        _SCRATCH.pop()


def drop_all(made: list[Tables]) -> None:
    for tables in made:
        tables.drop()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to differ from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def numbered(docs: DataFrame, tables: Tables) -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row, which stands however often the table is read; and that column's name."""
    (row,) = fresh(docs, "row_number")
    return tables.write(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Only the two columns an operator needs, so extra columns never clash; with ``row_col`` its numbers as row."""
    row = [docs[row_col].alias("row")] if row_col else []
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *row)


def texts_of(column: pa.Array, as_bytes: bool = True, at_once: int = 256) -> Iterator[bytes | str | None]:
    """The values of an Arrow text column, ``at_once`` Python objects at a time."""
    for i in range(0, len(column), at_once):
        part = column.slice(i, at_once)
        yield from (part.cast(pa.binary()) if as_bytes else part).to_pylist()


def arrow_rows(one: Callable[[bytes | str | None], tuple], schema: pa.Schema, as_bytes: bool = True) -> Callable:
    """A mapInArrow function: ``(doc_id, text)`` batches in, doc_id and ``one(text)``'s fields out; then columns after the text as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_state()
        for batch in batches:
            rows = [one(x) for x in texts_of(batch.column(1), as_bytes)]
            rest = batch.columns[2:]
            fields = list(schema)[1 : len(schema) - len(rest)]
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            arrays = [batch.column(0).cast(schema.field(0).type)]
            arrays += [pa.array(v, f.type) for v, f in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + rest, schema=schema)

    return run


def held_out(remainder: int, modulus: int):
    """True where crc32 of the id's decimal text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def sample_bound(n: int, at_most: int) -> int:
    """The 64-bit hashes under it are about ``at_most`` of ``n``; some are, however large n is."""
    return -(2**63) + min(2**64 - 1, 2**64 * at_most // max(n, 1))


def sample_hash(*key: str) -> Column:
    return F.xxhash64(*key, F.lit("fit"))


def bounded_sample(rows: DataFrame, at_most: int, *key: str) -> DataFrame:
    """About ``at_most`` of ``rows`` (all, when fewer), chosen by a hash of ``key``; for fitting only."""
    n = rows.count()
    return rows if n <= at_most else rows.where(sample_hash(*key) < sample_bound(n, at_most))


_STATE: dict[tuple, object] = {}


def worker_state(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps from one task to the next: one thing, so that the memories of operators don't add up."""
    if key not in _STATE:
        release_state()
        _STATE[key] = make()
    return _STATE[key]


def release_state() -> None:
    """Free what an operator before has left in this worker."""
    if _STATE:
        _STATE.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def released(df: DataFrame) -> DataFrame:
    """The rows as they are; the workers they pass through free what they remember."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_state()
        yield from batches

    return df.mapInArrow(run, df.schema)


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Rows that the driver made. From Arrow the JVM reads them itself; a list of tuples goes through Python workers of another kind, which then stay beside the operators'."""
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema))
