"""A training-data pipeline over ``documents``: language, exact and near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``.

1. language: rows whose text has no letter, or fewer than ``LEAST_COVERAGE`` of whose n-grams any learnt language
   contains, go; the filters learn from all labelled rows of the stage's own input, and where these give no
   language, every row whose text has a letter stays.
2. exact: one row of each group of equal texts stays.
3. near: one row of each group of near-duplicates stays, the one with the smallest doc_id; links are all pairs whose
   five-word shingles have a Jaccard similarity of 0.8 or more.
4. benchmark: rows in which a benchmark item is found go.
5. packing: the pieces of the packed sequences.

Defined cases, by stage: null, empty and blank texts and texts without a letter go in stage 1 (stages 2 to 5 by themselves
take null as empty); repeated rows count as copies; of equal texts the row with the smallest doc_id stays, of rows with one
id any one of them; a null doc_id is larger than any other; very long texts are read whole by every stage; an empty table gives an empty
result of the same columns; further columns are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrasto.llm.common import documents, materialize, small_batches, unused_name
from contrasto.llm.decontaminate import clean
from contrasto.llm.exact_dedup import exact_dedup
from contrasto.llm.language_id import UNKNOWN, fit, predictor
from contrasto.llm.near_pairs import near_groups
from contrasto.llm.packing import pack

#: Share of a text's n-grams that its language must contain; invented prose and names stay far above.
LEAST_COVERAGE = 0.3
#: Input files whose names are sent to all tasks (some 200 bytes each).
MOST_FILES = 50_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = unused_name(docs, "found_language")
    found = docs.withColumn(name, predictor(docs, model)("text"))
    return found.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= LEAST_COVERAGE)).drop(name)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a number of their own that every scan gives alike, however it is split.

    Rows of Parquet files are numbered by their file and their place in it, so texts are not written again.  Other rows, and those of
    more files than ``MOST_FILES`` (whose list is sent to all tasks), get numbers that are written once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    name = unused_name(docs, "row_number_")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":  # a plain scan, so that no row comes twice
        files = docs.select(F.col("_metadata.file_path").alias("path")).distinct().limit(MOST_FILES + 1).toArrow().column("path").to_pylist()
        if len(files) <= MOST_FILES:
            number, path = unused_name(docs, "file_number_"), unused_name(docs, "file_path_")
            known = spark.createDataFrame([(k, f) for k, f in enumerate(sorted(files))], f"{number} long, {path} string")
            placed = docs.withColumns({path: F.col("_metadata.file_path"), name: F.col("_metadata.row_index")}).join(F.broadcast(known), path)
            return placed.select(*docs.columns, F.shiftleft(number, 40).bitwiseOR(F.col(name)).alias(name)), name
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, name = _numbered(docs)
    gone = exact_dedup(rows, row_col=name).where("not kept").select(F.col("row_key").alias(name))
    return rows.join(gone, name, "left_anti").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, name = _numbered(docs)
    groups = materialize(near_groups(rows.select(F.col(name).alias("row"), "text")), "near")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", name)).alias("first")
    best = rows.select("doc_id", name).join(groups.withColumnRenamed("row", name), name).groupBy("group").agg(least)
    return rows.join(best.select(F.col(f"first.{name}").alias(name)), name, "left_semi").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("packing", packing)]

#: Language filters, edit distances and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
