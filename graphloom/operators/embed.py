"""Text that a node is embedded by, its URL keywords, and a pluggable vectoriser."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import tokens

URL = r"https?://[^\s'\"\\]+"
#: Callees that say nothing about a node.
PLAIN_CALLEES = ("self", "cls", "super", "print", "len", "str", "int")
FOLLOWED = ("calls", "depends")
MOST_CALLEES, MOST_SNIPPET = 8, 300


def urls(text: Column) -> Column:
    """Distinct URLs in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(URL), F.lit(0)))


def url_keywords(text: Column) -> Column:
    return F.array_join(urls(text), " ")


def clean_signature(signature: Column) -> Column:
    c = F.regexp_replace(signature, r":[^,)=]+", "")
    c = F.regexp_replace(c, r"=\s*[^,)]+", "")
    return F.trim(F.regexp_replace(c, r"[(),]", " "))


def clean_snippet(text: Column) -> Column:
    """Lines joined by spaces without comments and docstrings; as joining goes first, # cuts off all behind it."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    c = F.regexp_replace(F.array_join(lines, " "), "#.*", "")
    c = F.regexp_replace(c, '(?s)""".*?"""', "")
    c = F.regexp_replace(c, "(?s)'''.*?'''", "")
    return F.substring(F.trim(c), 1, MOST_SNIPPET)


def callee_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, callees: names that a node calls or depends on, without plain ones, a few at most. They go by name, as the rows of
    a table of edges have no order."""
    names = nodes.where(F.col("node_type") != "import").select(F.col("id").alias("target_id"), "name")
    called = edges.where(F.col("edge_type").isin(*FOLLOWED)).join(names, "target_id")
    worth = called.where((F.length("name") > 3) & ~F.col("name").isin(*PLAIN_CALLEES)).select("source_id", "name").distinct()
    return worth.groupBy("source_id").agg(F.slice(F.array_sort(F.collect_list("name")), 1, MOST_CALLEES).alias("callees"))


def embed_text(node_type: Column, name: Column, title: Column, file_path: Column, signature: Column, callees: Column, body: Column) -> Column:
    """Folders, title or kind and name, signature, callees, URLs and snippet, two spaces between."""
    folders = F.filter(F.slice(F.split(F.replace(file_path, F.lit("\\"), F.lit("/")), "/"), 1, F.greatest(F.size(F.split(F.replace(file_path, F.lit("\\"), F.lit("/")), "/")) - 1, F.lit(0))), lambda x: ~x.isin("", ".", "src"))
    parts = [
        F.array_join(folders, " "),
        F.when((title != "") & (title != name), title).otherwise(F.concat_ws(" ", node_type, name)),
        clean_signature(F.coalesce(signature, F.lit(""))),
        F.array_join(F.coalesce(callees, F.array().cast("array<string>")), " "),
        url_keywords(F.coalesce(body, F.lit(""))),
        clean_snippet(F.coalesce(body, F.lit(""))),
    ]
    return F.concat_ws("  ", *[F.when(p != "", p) for p in parts])


def hashed_vectors(texts: DataFrame, dims: int = 64) -> DataFrame:
    """(node_id, text) -> (node_id, vector, dims): signed counts of token hashes, scaled to length 1. A stand-in for a model that
    needs no download; it knows words, not meanings."""
    words = texts.select("node_id", F.explode(tokens(F.col("text"))).alias("w"))
    bits = lambda first, n: F.conv(F.substring(F.md5("w"), first, n), 16, 10).cast("long")
    cell = words.groupBy("node_id", F.pmod(bits(1, 8), F.lit(dims)).alias("k")).agg(F.sum(F.when(bits(9, 2) % 2 == 0, 1.0).otherwise(-1.0)).alias("x"))
    rows = texts.select("node_id").distinct().join(cell.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("m")), "node_id", "left")
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("m")[i.cast("bigint")], F.lit(0.0)))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("raw", raw).select("node_id", F.transform("raw", lambda x: (x / F.greatest(norm, F.lit(1e-9))).cast("float")).alias("vector"), F.lit(dims).alias("dims"))


def backends() -> list[str]:
    """Which model runtimes can be imported here, for model_vectors."""
    return [x for x in ("onnxruntime", "sentence_transformers") if importlib.util.find_spec(x)]


def model_vectors(texts: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]], chunk: int = 256) -> DataFrame:
    """(node_id, text) -> (node_id, vector, dims) by any model: `model()` is called once a task and gives a function on texts."""

    def each(batches):
        embed = model()
        for b in batches:
            for i in range(0, len(b), chunk):
                part = b.iloc[i : i + chunk]
                v = embed(part["text"].tolist())
                yield pd.DataFrame({"node_id": part["node_id"], "vector": list(v), "dims": [len(x) for x in v]})

    return texts.select("node_id", "text").mapInPandas(each, "node_id string, vector array<float>, dims int")


def missing_embeddings(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Nodes that take an embedding and have none; imports take none."""
    return nodes.where(F.col("node_type") != "import").join(embeddings.select(F.col("node_id").alias("id")), "id", "left_anti")
