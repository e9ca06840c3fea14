"""A landing folder as a stream: each micro-batch of files is ingested, its chunks and log appended.

Identifiers are deterministic and every batch writes under its own number, replacing what an
interrupted attempt left there: a batch that is run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark import workspace
from foliospark.config import Settings
from foliospark.operators import jobs
from foliospark.plans import ingest
from foliospark.sources.decoders import REGISTRY, Registry

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def start(spark: SparkSession, landing: str, out: str, checkpoint: str, cfg: Settings = Settings(), registry: Registry = REGISTRY, files_per_batch: int = 1000, available_now: bool = True, **how) -> StreamingQuery:  # type: ignore[no-untyped-def]
    """Chunks go to ``out/chunks``, results to ``out/results``, file states to ``out/log``, each by batch."""

    def batch(found: DataFrame, number: int) -> None:
        with workspace.scratch(spark):  # a stream has no end: what a batch puts aside goes with it
            done = ingest.ingest(found, cfg, registry, **how)
            for name, df in (("chunks", done.chunks), ("results", done.results), ("log", states(done.results, number))):
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    known = sorted(registry.extensions())
    found = (
        spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(landing)
        .filter(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*known))
    )
    writer = found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def states(results: DataFrame, number: int) -> DataFrame:
    """The file states that a batch of results ends in."""
    status = F.create_map(*[F.lit(x) for kv in jobs.OF_RESULT.items() for x in kv])
    return results.select(
        F.lit(f"batch-{number}").alias("job_id"), F.col("doc_id").alias("file_id"), F.element_at(F.split("source_uri", "/"), -1).alias("filename"), "file_type",
        status[F.col("status")].alias("status"), F.lit(100).alias("progress"), "chunk_count", "parent_count", "child_count", "total_tokens", "parent_strategy",
        F.to_json("warnings").alias("warnings"), "error", F.current_timestamp().alias("updated_at"),
    )


def live_states(log: DataFrame) -> DataFrame:
    """The last state of each file of a streamed log, kept up to date: for ``complete`` or ``update``
    output. The state holds one row a file; late rows of earlier states change nothing, so no
    watermark is needed to be right. Roll-ups are read from the result by ``jobs.rollup``."""
    return jobs.latest(log)
