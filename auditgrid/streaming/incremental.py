"""Audits of files as they arrive, each file by its newest version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditgrid.config import Config
from auditgrid.operators import audit as A
from auditgrid.schema import FILES_DDL

#: A landed file's version: of two landings of one path the higher one counts, of equal ones the later. A null content deletes the file.
LANDED_DDL = FILES_DDL + ", version long"
VERSIONS_DDL = "repo string, relative_path string, version long"


def file_stream(spark: SparkSession, landing: str, files_per_trigger: int = 64) -> DataFrame:
    """Snapshots of files (Parquet with the columns of ``files``, and version if they have one) that land in a folder."""
    return spark.readStream.schema(LANDED_DDL).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)


def newest(landed: DataFrame) -> DataFrame:
    """Of each path of each repository the row with the highest version; of equal ones the last content by order, so a batch that is run again gives the same."""
    rows = landed if "version" in landed.columns else landed.withColumn("version", F.lit(0).cast("long"))
    rows = rows.withColumn("version", F.coalesce("version", F.lit(0).cast("long")))
    last = F.max(F.struct("version", "content", "file_id")).alias("r")
    return rows.groupBy("repo", "relative_path").agg(last).select("r.file_id", "repo", "relative_path", "r.content", "r.version")


def audit_stream(files: DataFrame, out: str, checkpoint: str, config: Config = Config(), once: bool = True) -> StreamingQuery:
    """Append the findings of each batch of files to a Parquet table, one folder per batch, and beside it the versions that the batch has.

    A batch that is run again after a failure overwrites its own folders, so findings are written once. Rules
    look at single files. A file that lands again, or goes, takes its old findings back: ``findings`` reads those of the
    newest versions alone. A repository's middleware may land before or after its routes, so the findings are
    written as they are before re-scoring, middleware files beside them; ``findings`` brings all together.
    """

    def write(batch: DataFrame, number: int) -> None:
        # file sinks of a batch are replaced as a whole
        last = newest(batch)
        last.select("repo", "relative_path", "version").write.mode("overwrite").parquet(f"{out}-versions/batch={number}")
        A.audit(last.drop("version"), config, rescore=False).write.mode("overwrite").parquet(f"{out}/batch={number}")
        A.middleware_files(last.drop("version"), config).write.mode("overwrite").parquet(f"{out}-middleware/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """``repo, relative_path, batch``: the batch that has each path's newest version, of equal versions the latest batch."""
    versions = spark.read.schema(VERSIONS_DDL + ", batch long").parquet(f"{out}-versions")
    return versions.groupBy("repo", "relative_path").agg(F.max(F.struct("version", "batch")).alias("v")).select("repo", "relative_path", F.col("v.batch").alias("batch"))


def _of_current(rows: DataFrame, now: DataFrame) -> DataFrame:
    now = now.select(F.col("repo").alias("n_repo"), F.col("relative_path").alias("n_path"), F.col("batch").alias("n_batch"))
    same = rows["repo"].eqNullSafe(now["n_repo"]) & (rows["relative_path"] == now["n_path"]) & (rows["batch"] == now["n_batch"])
    return rows.join(now, same, "left_semi")


def findings(spark: SparkSession, out: str) -> DataFrame:
    """The findings of the newest versions of all files so far, re-scored by their middleware.

    A semi join on path and batch; no state is held between batches, and a late landing of an old version changes nothing.
    """
    now = current(spark, out)
    found = _of_current(spark.read.parquet(out), now)
    ways = _of_current(spark.read.schema(FILES_DDL + ", batch long").parquet(f"{out}-middleware"), now).drop("batch")
    return A.rescored(found, A.middleware(ways))


def compact(spark: SparkSession, out: str, to: str) -> None:
    """Write what the newest versions have (findings, versions, middleware) as one batch of a new table ``to``, which a stream can go on with.

    The batch number is that of the latest batch, so later ones of ``to`` win. Reading costs what the files have, not what the history has.
    """
    now = current(spark, out)
    versions = _of_current(spark.read.schema(VERSIONS_DDL + ", batch long").parquet(f"{out}-versions"), now)
    last = versions.agg(F.max("batch")).first()[0]
    for suffix, rows in (("", spark.read.parquet(out)), ("-middleware", spark.read.schema(FILES_DDL + ", batch long").parquet(f"{out}-middleware"))):
        _of_current(rows.withColumn("batch", F.col("batch").cast("long")), now).drop("batch").write.mode("overwrite").parquet(f"{to}{suffix}/batch={last}")
    versions.drop("batch").write.mode("overwrite").parquet(f"{to}-versions/batch={last}")
