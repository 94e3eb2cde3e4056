"""Incremental store ingestion by Structured Streaming: new files since the last run, then stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contrasto.sources import store


def ingest_stream(spark: SparkSession, folder: str, root: str, checkpoint: str, files_at_a_time: int = 1000) -> None:
    """Files of ``folder`` not yet seen by ``checkpoint`` go to the store under ``root`` and its ledger; documents already there stay as they are.

    The stream only finds files; a batch of them is read like a batch ingestion, with strict lines in their order.  A batch that
    runs again finds its shards in the ledger, so it adds nothing twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in batch.select("path").distinct().collect())  # at most files_at_a_time
        if paths:
            store.ingest(spark, paths, root)

    kind = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.schema(kind).format("binaryFile").option("maxFilesPerTrigger", files_at_a_time).load(folder).select("path")
    query = found.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
