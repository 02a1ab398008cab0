"""Folder roll-up and graph-wide aggregates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import root_folder
from graphloom.shipping import ship

MOST_NAMES = 20
BUCKETS = {"class": "classes", "function": "functions", "method": "methods"}


def feature_map(nodes: DataFrame) -> DataFrame:
    """For each folder the distinct names of classes, functions and methods, counted and listed up to a cap.

    Of a folder's names only the first `MOST_NAMES` of a kind are ever gathered, picked before and after the shuffle; the rest is counted.
    """
    shown = nodes.where(F.col("node_type").isin(*BUCKETS)).select(root_folder(F.col("file_path")).alias("folder"), "node_type", "name").distinct()
    every = shown.groupBy("folder", "node_type").agg(F.count(F.lit(1)).alias("n"))
    first = shown.withColumn("r", F.row_number().over(Window.partitionBy("folder", "node_type").orderBy("name"))).where(F.col("r") <= MOST_NAMES)
    first = first.groupBy("folder", "node_type").agg(F.array_sort(F.collect_list("name")).alias("names"))
    more = F.col("n") - MOST_NAMES
    capped = F.when(more > 0, F.concat("names", F.array(F.concat(F.lit("… +"), more.cast("string"), F.lit(" more"))))).otherwise(F.col("names"))
    rows = every.join(first, ["folder", "node_type"], "left").select("folder", "node_type", "n", F.coalesce(capped, F.array().cast("array<string>")).alias("names"))
    parts = []
    for kind, plural in BUCKETS.items():
        own = F.col("node_type") == kind
        parts += [F.coalesce(F.first(F.when(own, F.col("names")), True), F.array().cast("array<string>")).alias(plural), F.coalesce(F.max(F.when(own, F.col("n"))), F.lit(0)).alias(f"{plural}_count")]
    return rows.groupBy("folder").agg(*parts)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count."""
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).join(edges.agg(F.count(F.lit(1)).alias("edge_count")), F.lit(True))


def snapshot_hash(nodes: DataFrame) -> DataFrame:
    """SHA-256 of all ids in order, joined by |. The definition takes all ids as one string: one task reads them sorted (the sort spills)
    and hashes them as they come, so no array of ids is ever made."""
    ship(nodes.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = hashlib.sha256(), 0
        for b in batches:
            ids = b.column(0).to_pylist()
            if ids:
                h.update(("|" if n else "").encode() + "|".join(ids).encode())
                n += len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()]), pa.array([n], pa.int64())], names=["snapshot_hash", "node_count"])

    ids = nodes.where(F.col("id").isNotNull()).select("id").repartition(1).sortWithinPartitions("id")
    row = ids.mapInArrow(each, "snapshot_hash string, node_count long")
    return row.agg(F.coalesce(F.max("snapshot_hash"), F.lit(hashlib.sha256().hexdigest())).alias("snapshot_hash"), F.coalesce(F.max("node_count"), F.lit(0)).alias("node_count"))
