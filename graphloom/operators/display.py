"""Result rows as tools print them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import short_id

SNIPPET_LINES = 12


def snippet(text: Column, line_start: Column, n: int | Column = SNIPPET_LINES) -> Column:
    """Lines of a source text from line_start on."""
    count = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), F.greatest(line_start, F.lit(1)), F.greatest(count, F.lit(0))), "\n")


def body(text: Column, line_start: Column, line_end: Column) -> Column:
    return snippet(text, line_start, line_end - line_start + 1)


def node_rows(nodes: DataFrame, *more: str) -> DataFrame:
    return nodes.select("id", F.col("node_type").alias("type"), "name", "title", F.col("file_path").alias("file"), F.concat_ws("-", "line_start", "line_end").alias("lines"), "signature", *more)


def with_snippets(nodes: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
    """node_rows with a snippet of the node's file; null where there is none. texts: file_path, text."""
    joined = nodes.join(texts.select(F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")).alias("_p"), "text"), F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")) == F.col("_p"), "left")
    cut = snippet(F.col("text"), F.col("line_start"))
    return node_rows(joined.withColumn("snippet", F.when(F.length(cut) > 0, cut)), *more, "snippet")


def edge_rows(edges: DataFrame) -> DataFrame:
    """Edges with ids cut to what people read."""
    return edges.select(short_id(F.col("source_id")).alias("source"), short_id(F.col("target_id")).alias("target"), "edge_type")


def affected_rows(nodes: DataFrame) -> DataFrame:
    """Affected nodes as people read them: by type, then title."""
    return nodes.select(F.col("node_type").alias("type"), "title", F.col("file_path").alias("file"), short_id(F.col("id")).alias("id"), *[c for c in ("depth",) if c in nodes.columns]).orderBy("type", "title", "id")


def listing(found: DataFrame) -> DataFrame:
    """Search results as a command prints them: type, title, place, score of two digits, short id."""
    return found.select(F.col("node_type").alias("type"), "title", F.concat_ws(":", "file_path", "line_start").alias("place"), F.format_number("score", 2).alias("score"), short_id(F.col("id")).alias("id"))


def score_rows(found: DataFrame, places: int = 3) -> DataFrame:
    return node_rows(found.withColumn("score", F.round("score", places)), "score")
