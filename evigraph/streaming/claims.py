"""Claims, evidence and nodes that keep arriving: merged tables maintained batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.merge import TRIPLE, merge_claims, merge_evidence, merge_nodes

Merge = Callable[[DataFrame], dict[str, DataFrame]]


def merged_claims(raw: DataFrame) -> dict[str, DataFrame]:
    return {"claims": merge_claims(raw)}


def merged_claims_and_evidence(raw: DataFrame) -> dict[str, DataFrame]:
    return {"claims": merge_claims(raw), "evidence": merge_evidence(raw)}


def merged_nodes(raw: DataFrame) -> dict[str, DataFrame]:
    nodes, attrs = merge_nodes(raw)
    return {"nodes": nodes, "attrs": attrs}


def _bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.expr(f"cast(pmod(xxhash64({', '.join(keys)}), {buckets}) as int)"))


def update(rows: DataFrame, batch_id: int, keys: Sequence[str], merge: Merge, raw_path: str, merged_path: dict[str, str], buckets: int) -> None:
    """One batch: its rows replace what an earlier attempt at it left, then the buckets it touches are merged anew.

    Merging starts from all raw rows of a bucket (what fills a blank depends on
    order, so merged rows wouldn't do). Each step overwrites whole folders, so a
    batch that failed anywhere and runs again ends in the same state.
    """
    spark: SparkSession = rows.sparkSession
    at = f"{raw_path}/batch={batch_id}"
    _bucket(rows, keys, buckets).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(at)
    touched = [r["bucket"] for r in spark.read.schema("bucket int").parquet(at).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    known = spark.read.schema(StructType([*rows.schema.fields, *StructType.fromDDL("batch long, bucket int").fields])).parquet(raw_path).filter(F.col("bucket").isin(touched)).drop("batch", "bucket")
    for name, merged in merge(known).items():
        _bucket(merged, keys, buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(merged_path[name])


def maintain_tables(stream: DataFrame, keys: Sequence[str], merge: Merge, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the tables that ``merge`` makes of a stream's rows in Parquet under path/name; raw rows under path/raw.

    ``merge`` must treat rows of different keys apart, as the merges of claims and
    evidence (by triple) and of nodes (by graph and id) do.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        update(rows, batch_id, keys, merge, f"{path}/raw", _Under(path), buckets)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Under(dict):
    """Paths by name under one folder."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path

    def __missing__(self, name: str) -> str:
        return f"{self.path}/{name}"


def maintain_nodes(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Merged nodes and their attributes of a stream of sightings (see merge_nodes), under path/nodes and path/attrs."""
    return maintain_tables(stream, ("graph_id", "id"), merged_nodes, path, checkpoint, buckets)


def maintain_claims(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Merged claims and their distinct evidence of a stream of raw claims, under path/claims and path/evidence."""
    return maintain_tables(stream, TRIPLE, merged_claims_and_evidence, path, checkpoint, buckets)


def maintain(stream: DataFrame, raw_path: str, merged_path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps merged claims of a stream of raw claims (see merge_claims) in Parquet, by bucket of the triple."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        update(rows, batch_id, TRIPLE, merged_claims, raw_path, {"claims": merged_path}, buckets)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
