"""The engine: builds a graph from source trees and answers queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import build, display, embed, parse, rollup, search, traverse
from graphloom.schemas import NODE_COLUMNS, UNRESOLVED
from graphloom.shared import written
from graphloom.sources import files as source_files
from graphloom.sources.store import GraphStore, Version


class Engine:
    """Queries over a stored graph, and its builds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, GraphStore(spark, path)

    @property
    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("edges")

    @property
    def embeddings(self) -> DataFrame:
        return self.store.read("embeddings")

    @property
    def edges_in(self) -> DataFrame:
        """The edges, laid out by target."""
        return self.store.read("edges_in")

    @property
    def full_text(self) -> search.Index:
        return search.Index(self.store.read("postings"), self.store.read("lengths"))

    def index(self, root: str | list[str], full: bool = False, rules=(), vectors=None, plugins: bool = True):
        """Reads changed files under root and returns the snapshot's row. Files of other roots stay as they are; of several roots only the
        first can start anew.

        vectors: a function from (node_id, text) to (node_id, vector, dims), e.g. embed.hashed_vectors; None embeds nothing.
        """
        if not isinstance(root, str):
            return [self.index(r, full and not k, rules, vectors, plugins) for k, r in enumerate(root)][-1]
        return self._build(root, full, rules, vectors, plugins)

    def index_report(self, roots: list[str], **options) -> dict:
        """index() over several roots, and what tools say of it."""
        last = self.index(roots, **options)
        return {"snapshot_hash": last["snapshot_hash"][:16], "paths_indexed": len(roots), "files": last["file_count"], "nodes": last["node_count"], "edges": last["edge_count"]}

    def _build(self, root: str, full: bool, rules, vectors, plugins: bool):
        """One version a build, with the tables that change."""
        store, spark = self.store, self.spark
        read = store.empty if full else store.read
        manifest = read("manifest")
        found = written(spark, source_files.discover(spark, root).select("file_path", "content_hash"), "build-files")
        diff = written(spark, build.manifest_diff(found, manifest.where(F.col("root") == root)), "build-diff")
        if not full and diff.where("status <> 'same'").isEmpty() and (now := store.snapshot()) is not None:
            return now
        old_nodes, raw, stubs = read("nodes"), read("raw_edges"), read("stubs")
        gone = diff.where(F.col("status").isin("changed", "deleted"))
        real = old_nodes.where(F.col("file_path") != UNRESOLVED)
        kept, raw, vectors_left = build.delete_files(real, raw, read("embeddings"), gone)
        texts = source_files.texts_of(spark, root, diff.where(F.col("status").isin("new", "changed")).select("file_path"))
        parsed = written(spark, parse.parse_files(texts, [*rules, *(source_files.load_plugins(self._dependencies(root)) if plugins else [])]), "build-parsed")
        new_nodes, new_edges = parse.nodes_of(parsed), parse.edges_of(parsed)
        all_stubs = stubs.unionByName(new_nodes.where(F.col("file_path") == UNRESOLVED)).dropDuplicates(["id"])
        version = store.begin()
        all_stubs = version.put("stubs", all_stubs)
        raw = version.put("raw_edges", build.upsert_edges(raw, new_edges))
        known = written(spark, build.upsert_nodes(kept, new_nodes.where(F.col("file_path") != UNRESOLVED)), "build-known")
        edges, needed = build.resolve_names(raw, known, all_stubs)
        edges = written(spark, edges, "build-edges")
        nodes = known.unionByName(needed.select(*NODE_COLUMNS)).dropDuplicates(["id"])
        if vectors is None:
            nodes = version.put("nodes", nodes)
            version.put("embeddings", vectors_left)
        else:
            nodes = written(spark, nodes, "build-nodes")
            made, nodes = self._embedded(nodes, edges, vectors_left, source_files.texts_of(spark, root, found.select("file_path")), vectors)
            version.put("embeddings", made)
            nodes = version.put("nodes", nodes)
        edges = version.put("edges", build.valid_edges(edges, nodes))
        self._indexed(version, old_nodes, nodes, read)
        now = F.current_timestamp()
        manifest = version.put("manifest", manifest.where(F.col("root") != root).unionByName(found.select("file_path", "content_hash", now.alias("indexed_at"), F.lit(root).alias("root"))))
        row = rollup.snapshot_hash(nodes).join(edges.agg(F.count(F.lit(1)).alias("edge_count")), F.lit(True)).join(manifest.agg(F.count(F.lit(1)).alias("file_count")), F.lit(True))
        version.put("snapshot", row.select("snapshot_hash", now.alias("indexed_at"), "file_count", "node_count", "edge_count", F.lit(root).alias("root_path")))
        version.commit()
        return store.snapshot()

    def _indexed(self, version: Version, old: DataFrame, nodes: DataFrame, read) -> None:
        """Postings and lengths: those of nodes that stay as they were are kept, the others are cut anew."""
        was = old.select("id", F.xxhash64(*search.COLUMNS).alias("was"))
        now = nodes.select("id", F.xxhash64(*search.COLUMNS).alias("now"))
        other = written(self.spark, was.join(now, "id", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("id"), "build-changed")
        fresh = nodes.join(other, "id", "left_semi")
        for table, cut in (("postings", search.postings), ("lengths", search.lengths)):
            version.put(table, read(table).join(other, "id", "left_anti").unionByName(cut(fresh)))

    def _dependencies(self, root: str) -> set[str]:
        text = self.spark.read.format("binaryFile").option("pathGlobFilter", "{requirements.txt,pyproject.toml,package.json}").load(root)
        named = {d for r in text.select("path", "content").collect() for d in source_files.dependencies(r["path"], bytes(r["content"]).decode("utf-8", "replace"))}
        return named | source_files.installed(self.spark, root)

    def _embedded(self, nodes: DataFrame, edges: DataFrame, have: DataFrame, texts: DataFrame, vectors) -> tuple[DataFrame, DataFrame]:
        """Embeddings with those that were lacking, and nodes with the URL keywords of those that lacked one."""
        need = build_rows(embed.missing_embeddings(nodes, have), texts)
        callees = embed.callee_names(nodes, edges).withColumnRenamed("source_id", "id")
        text = embed.embed_text(F.col("node_type"), F.col("name"), F.col("title"), F.col("file_path"), F.col("signature"), F.col("callees"), F.col("body"))
        made = vectors(need.join(callees, "id", "left").select(F.col("id").alias("node_id"), text.alias("text")))
        made = made.select("node_id", "vector", "dims", F.current_timestamp().alias("embedded_at"))
        words = need.select("id", embed.url_keywords(F.coalesce("body", F.lit(""))).alias("keywords")).where("keywords <> ''")
        return build.upsert_by(have, made, "node_id"), build.update_keywords(nodes, words)

    def embed(self, texts: DataFrame, vectors=embed.hashed_vectors) -> None:
        """Embeds nodes that have no vector and writes their URL keywords."""
        old, version = self.nodes, self.store.begin()
        made, nodes = self._embedded(old, self.edges, self.embeddings, texts, vectors)
        version.put("embeddings", made)
        self._indexed(version, old, version.put("nodes", nodes), self.store.read)
        version.commit()

    def status(self):
        return self.store.snapshot()

    def search(self, query: str, limit: int = 10, scope: str | None = None, vector: list[float] | None = None, texts: DataFrame | None = None) -> DataFrame:
        found = search.search_hybrid(self.nodes, query, self.embeddings if vector else None, vector, limit, scope, self.full_text)
        found = found.withColumn("score", F.round("score", 3))
        return display.with_snippets(found, texts, "score") if texts is not None else display.node_rows(found, "score")

    def context(self, node: str, max_depth: int = 3, scope: str | None = None, mode: str = "breadth"):
        traverse.require_node(self.nodes, node)
        if mode == "depth":
            return traverse.context_depth_first(self.nodes, self.edges, node, max_depth, scope)
        return traverse.Context(self.nodes, self.edges, node, max_depth, scope)

    def blast_radius(self, node: str, max_depth: int = 5) -> tuple[DataFrame, DataFrame]:
        """Affected nodes, and the one-row score."""
        traverse.require_node(self.nodes, node)
        return traverse.blast_radius(self.nodes, self.edges_in, node, max_depth), traverse.blast_score(self.nodes, self.edges_in, node, max_depth)

    def feature_map(self) -> DataFrame:
        return rollup.feature_map(self.nodes).orderBy("folder")

    def edges_of(self, node: str) -> DataFrame:
        return traverse.edge_listing(self.nodes, self.edges, node, self.edges_in)

    def named(self, name: str) -> str:
        """Id of the best match of a name, an equal one first."""
        row = search.exact_name_first(search.search_hybrid(self.nodes, name, limit=20, index=self.full_text), name).head()
        if row is None:
            raise traverse.UnknownNode(f"Node not found: {name}")
        return row["id"]


def build_rows(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """nodes with `body`, their lines of the file's text."""
    t = texts.select("file_path", "text")
    return nodes.join(t, "file_path", "left").withColumn("body", display.body(F.col("text"), F.col("line_start"), F.col("line_end"))).select(*NODE_COLUMNS, "body")

