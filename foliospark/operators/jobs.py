"""Batch jobs: an append-only log of file states, and everything else read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("done", "partial", "failed")
OF_RESULT = {"success": "done", "partial": "partial", "failed": "failed"}


def latest(log: DataFrame) -> DataFrame:
    """The last state of each file by ``updated_at``. At equal times an ended state wins over one that
    isn't, then the further progress; a late row of an earlier state changes nothing."""
    rank = F.struct(F.col("updated_at"), F.col("status").isin(*TERMINAL), F.coalesce("progress", F.lit(-1)), F.col("status"))
    rest = [c for c in log.columns if c not in ("job_id", "file_id")]
    return log.groupBy("job_id", "file_id").agg(F.max_by(F.struct(*rest), rank).alias("s")).select("job_id", "file_id", "s.*")


def file_progress(status: Column) -> Column:
    return F.when(status.isin(*TERMINAL), 100).when(status == "running", 50).otherwise(0)


def rollup(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job ``(job_id, total_files, files_done, files_failed, progress, status)`` from the last
    states of its files; a job without any is queued at 0. ``progress`` rounds halves to even."""
    ended = F.col("status").isin(*TERMINAL)
    of = files.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("status").isin("done", "partial")).alias("files_done"), F.count_if(F.col("status") == "failed").alias("files_failed"),
        F.bround(F.avg(file_progress(F.col("status")))).cast("int").alias("progress"), F.bool_and(ended).alias("_all"), F.bool_or(F.col("status") != "queued").alias("_any"),
        F.bool_and(F.col("status") == "failed").alias("_failed"), F.bool_or(F.col("status").isin("failed", "partial")).alias("_bad"),
    )
    status = F.when(F.col("total_files").isNull(), "queued").when(~F.col("_all"), F.when(F.col("_any"), "running").otherwise("queued")).when(F.col("_failed"), "failed").when(F.col("_bad"), "partial").otherwise("done")
    every = jobs.select("job_id").distinct().join(of, "job_id", "left")
    return every.select("job_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total_files", "files_done", "files_failed", "progress")], status.alias("status"))


def newest(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest jobs, ``limit`` of them, 1 to 500; by ``created_at``, then id."""
    return jobs.dropDuplicates(["job_id"]).orderBy(F.col("created_at").desc_nulls_last(), "job_id").limit(max(1, min(limit, 500)))


def files_of(files: DataFrame, job_id: str) -> DataFrame:
    return files.filter(F.col("job_id") == job_id).orderBy("created_at", "file_id")


def file(files: DataFrame, file_id: str) -> DataFrame:
    return files.filter(F.col("file_id") == file_id)


def queued(job_id: str, uploads: DataFrame) -> DataFrame:
    """First log rows of a job from ``uploads(file_id, filename, file_type)``."""
    now = F.current_timestamp()
    return uploads.select(F.lit(job_id).alias("job_id"), "file_id", "filename", "file_type", F.lit("queued").alias("status"), F.lit(0).alias("progress"), now.alias("created_at"), now.alias("updated_at"))


def finished(results: DataFrame, files: DataFrame) -> DataFrame:
    """Log rows of files whose ``results(source_uri, status, …)`` are there."""
    status = F.create_map(*[F.lit(x) for kv in OF_RESULT.items() for x in kv])
    return files.join(results, files["input_path"] == results["source_uri"]).select(
        files["job_id"], files["file_id"], files["filename"], files["file_type"], status[results["status"]].alias("status"), F.lit(100).alias("progress"),
        "chunk_count", "parent_count", "child_count", "total_tokens", "parent_strategy", F.to_json("warnings").alias("warnings"), results["error"], files["created_at"], F.current_timestamp().alias("updated_at"),
    )


def validate(uploads: DataFrame, extensions: set[str], most_bytes: int = 200 * 1024 * 1024) -> DataFrame:
    """``uploads(filename, length)`` with ``rejected``: the code 415, 413 or 400, or null. All files are
    judged before any is taken."""
    kind = F.lower(F.regexp_extract("filename", r"(\.[^./\\]+)$", 1))
    bad = F.when(~kind.isin(*sorted(extensions)), 415).when(F.col("length") > most_bytes, 413).when(F.coalesce("length", F.lit(0)) == 0, 400)
    return uploads.withColumn("rejected", bad)


def page(chunks: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of chunks in order of file and place, at most 100 000 of them."""
    return chunks.orderBy("doc_id", "chunk_seq", "chunk_id").offset(max(0, offset)).limit(max(1, min(limit, 100_000)))
