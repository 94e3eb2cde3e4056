"""Keyed inputs with their integrity rules: unique ids, latest rows, known pairs, taxonomy, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, after checking that it has rows and that its keys are present and unique."""
    bad = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.count_if((F.col("n") > 1) | (F.coalesce(F.col(key).cast("string"), F.lit("")) == "")).alias("bad")).first()
    if not bad["keys"] or bad["bad"]:
        raise ValueError(f"{key}: empty input" if not bad["keys"] else f"{key}: missing or repeated values")
    return df


def latest(df: DataFrame, key: str = "subgraph_id", order: str = "seq") -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def latest_kept(df: DataFrame, decision: str, key: str = "subgraph_id", order: str = "seq") -> DataFrame:
    """Latest rows that succeeded and were kept; the choice of the latest comes first."""
    kept = F.coalesce(F.col(f"{decision}.keep"), F.lit(False))
    return latest(df, key, order).where((F.col("status") == "success") & kept)


def known_pairs(df: DataFrame) -> DataFrame:
    """Distinct unordered pairs (left < right) from whichever id columns the rows have; pairs with an empty or equal side are dropped."""

    def ids(*paths: str) -> Column:
        have = [F.col(p) for p in paths if p.split(".")[0] in df.columns and _has(df, p)]
        return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in have], F.lit(None))

    left = ids("doc_a.doc_id", "doc_a.canonical_doc_id", "doc_a", "src_doc_id", "left_doc_id", "provenance.conflict_edge.src_doc_id")
    right = ids("doc_b.doc_id", "doc_b.canonical_doc_id", "doc_b", "dst_doc_id", "right_doc_id", "provenance.conflict_edge.dst_doc_id")
    return df.select(F.least(left, right).alias("left"), F.greatest(left, right).alias("right"), left.isNotNull().alias("l"), right.isNotNull().alias("r")).where("l and r and left <> right").select("left", "right").distinct()


def _has(df: DataFrame, path: str) -> bool:
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            return False
        kind = kind[part].dataType
    return not hasattr(kind, "fieldNames")


def load_taxonomy(df: DataFrame) -> DataFrame:
    """(path, discipline, field, subfield) of a three-level tree; raises if it has none."""
    d = df.select(F.explode("disciplines").alias("d"))
    f = d.select(F.col("d.name").alias("discipline"), F.explode("d.fields").alias("f"))
    s = f.select("discipline", F.col("f.name").alias("field"), F.explode("f.subfields.name").alias("subfield"))
    out = s.select(F.concat_ws(" -> ", "discipline", "field", "subfield").alias("path"), "*")
    if not out.limit(1).count():
        raise ValueError("the taxonomy has no paths")
    return out


def match_shards(tags: DataFrame, entities: DataFrame) -> DataFrame:
    """Shards of both sides (shard_id, file); raises on repeated, missing or no shards."""
    side = lambda df, n: df.groupBy("shard_id").agg(F.count("*").alias(f"n_{n}"), F.min("file").alias(n))
    both = side(tags, "tags").join(side(entities, "entities"), "shard_id", "full").fillna(0, ["n_tags", "n_entities"])
    c = both.agg(F.count("*").alias("n"), F.count_if((F.col("n_tags") != 1) | (F.col("n_entities") != 1)).alias("bad")).first()
    if not c["n"] or c["bad"]:
        raise ValueError("shards of tags and entities don't match one to one" if c["n"] else "no shards")
    return both.select("shard_id", "tags", "entities")


def todo(rows: DataFrame, done: DataFrame, key: str, order: str = "seq", limit: int = 0, errors_are_done: bool = False) -> DataFrame:
    """Rows still to process: the first ``limit`` in order, of these the ones not completed before."""
    if limit > 0:
        rows = rows.orderBy(order).limit(limit)
    done = done if errors_are_done else done.where("status = 'success'")
    return rows.join(done.select(key).distinct(), key, "left_anti")


def quotas(total: int, shards: int) -> list[int]:
    """A total split over shards as evenly as possible, the first ones taking the rest."""
    share, rest = divmod(total, shards)
    return [share + (k < rest) for k in range(shards)]


def take_per_shard(rows: DataFrame, quota: dict[str, int], shard: str = "shard_id", order: str = "line") -> DataFrame:
    """The first rows of each shard up to its quota."""
    spark = rows.sparkSession
    q = spark.createDataFrame(list(quota.items()) or [("", 0)], f"{shard} string, quota int")
    k = F.row_number().over(W.partitionBy(shard).orderBy(order))
    return rows.join(F.broadcast(q), shard).withColumn("k", k).where("k <= quota").drop("k", "quota")  # one row per shard


def take_shard(rows: DataFrame, key: str, shard: int, shards: int) -> DataFrame:
    """The rows of one of ``shards`` parts by a hash of their key, for a stage run part by part; every key lies in exactly one."""
    if not 0 <= shard < shards:
        raise ValueError(f"shard {shard} of {shards}")
    place = F.conv(F.substring(F.sha1(F.col(key)), 1, 15), 16, 10).cast("long")
    return rows.where(place % shards == shard)
