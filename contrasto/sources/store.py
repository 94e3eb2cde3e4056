"""The document store: first row wins per document, a ledger of ingested shards, batch or incremental."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrasto.sources import jsonl

STORE = "canonical_doc_id string, url string, text string"


def complete(rows: DataFrame) -> DataFrame:
    return rows.where("url <> '' and text <> ''")


def first_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per document, the first in order."""
    return complete(rows).groupBy("canonical_doc_id").agg(F.min_by(F.struct("url", "text"), F.struct(*order)).alias("r")).select("canonical_doc_id", "r.url", "r.text")


def ledger(rows: DataFrame, shard: str = "file") -> DataFrame:
    """Per shard: rows seen, and rows lacking url or text."""
    lacking = (F.col("url") == "") | (F.col("text") == "")
    return rows.groupBy(F.col(shard).alias("shard")).agg(F.count("*").alias("rows_seen"), F.count_if(lacking).alias("missing_url_or_text"))


def totals(store: DataFrame, shards: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("documents")).crossJoin(shards.agg(F.count("*").alias("shards"), F.coalesce(F.sum("rows_seen"), F.lit(0)).alias("rows_seen"), F.coalesce(F.sum("missing_url_or_text"), F.lit(0)).alias("missing_url_or_text")))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


LEDGER = "shard string, rows_seen long, missing_url_or_text long"


def ingest(spark: SparkSession, paths: list[str], root: str) -> dict:
    """Add shards that the ledger lacks to the store under ``root``; a second call with the same files adds nothing."""
    done, store = _read(spark, f"{root}/shards", LEDGER), _read(spark, f"{root}/docs", STORE)
    have = {r[0] for r in done.select("shard").collect()}  # one row per input file
    fresh = [p for p in paths if f"file:{p}" not in have and f"file://{p}" not in have and p not in have]
    if fresh:
        rows = jsonl.raw_documents(jsonl.read_jsonl(spark, fresh, jsonl.RAW_DOCUMENT))
        new = first_rows(rows, ["file", "line"]).join(store.select("canonical_doc_id"), "canonical_doc_id", "left_anti")
        new.write.mode("append").parquet(f"{root}/docs")
        ledger(rows).write.mode("append").parquet(f"{root}/shards")
    t = totals(_read(spark, f"{root}/docs", STORE), _read(spark, f"{root}/shards", LEDGER)).first()
    return t.asDict() | {"skipped_shards": len(paths) - len(fresh)}
