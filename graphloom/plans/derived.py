"""The graph that the registered queries run on, derived from the TPC-H-like tables, in Spark and in SQL.

region defines nation contains customer calls order references part; supplier calls part. With `cyclic` also part calls
supplier references nation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import node_id
from graphloom.schemas import EDGE_COLUMNS, NODE_COLUMNS
from graphloom.shared import released, written
from graphloom.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, kind: str, name: str, path, key: str) -> DataFrame:
    out = df.select(F.lit(kind).alias("node_type"), F.col(name).alias("name"), path.alias("file_path"), F.col(key).cast("int").alias("line_start"), F.col(key).cast("long").alias("key"))
    out = out.withColumn("id", node_id(F.col("node_type"), F.col("file_path"), F.col("name"), F.col("line_start")))
    return out.withColumns({"title": F.concat_ws(".", F.replace("file_path", F.lit("/"), F.lit(".")), F.col("name")), "line_end": F.col("line_start") + 10, "signature": F.lit(""), "keywords": F.lit("")})


#: Written tables by application, folder and kind: nodes, links, links by target, hubs, each once it is asked for.
KEPT: dict[tuple[str, str, bool], dict] = {}
#: Rows of (key, number) or (number, id) that are sent to all executors, at most; more are joined by a shuffle.
MOST_SENT = 1 << 21
#: A target of so many edges is a hub: its id is sent to the edges, not shuffled with them.
HUB = 4
COLUMNS = ["part", "key", "node_type", "name", "title", "file_path", "line_start", "line_end", "signature", "keywords"]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by id with their ids' place: the partition and the number of different ids before it; and which row is the first of its id."""
    base, last, n = TaskContext.get().partitionId() << 33, None, -1
    for b in batches:
        if not len(b):
            continue
        ids = b.column(0)
        first = np.append(ids[0].as_py() != last, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))
        place = n + np.cumsum(first)
        n, last = int(place[-1]), ids[-1].as_py()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base + place, pa.int64()), pa.array(first, pa.bool_())], names=[*b.schema.names, "place", "first"])


class Derived:
    def __init__(self, spark: SparkSession, sf_dir: str, cyclic: bool = False):
        self.spark, self.sf_dir, self.cyclic = spark, sf_dir, cyclic
        self.tables: dict = {}
        t = lambda n: table(spark, sf_dir, n)
        region = t("region")
        nation = t("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        place = F.concat_ws("/", "r_name", "n_name")
        customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        supplier = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        orders = t("orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("o_name", F.concat(F.lit("order"), F.col("o_orderkey").cast("string")))
        part = t("part")
        self.parts = {
            "region": _node(region, "module", "r_name", F.concat(F.col("r_name"), F.lit("/root")), "r_regionkey"),
            "nation": _node(nation, "class", "n_name", place, "n_nationkey"),
            "customer": _node(customer, "method", "c_name", F.concat(place, F.lit("/c")), "c_custkey"),
            "orders": _node(orders, "function", "o_name", F.concat(place, F.lit("/c/o")), "o_orderkey"),
            "supplier": _node(supplier, "function", "s_name", F.concat(place, F.lit("/s")), "s_suppkey"),
            "part": _node(part, "variable", "p_name", F.concat(F.lit("parts/"), F.col("p_brand")), "p_partkey"),
        }
        one = lambda t_, x, y: t(t_).select(F.col(x).alias("a"), F.col(y).alias("b"))
        # dealt by one key before the pairs are made distinct, so that the join by this key moves nothing
        pairs = lambda x, y: one("lineitem", x, y).repartition("a").distinct()
        #: parts of both ends, keys of both, type, whether the edge goes from b to a
        self.links_by_key = [
            ("region", "nation", one("nation", "n_regionkey", "n_nationkey"), "defines", False),
            ("nation", "customer", one("customer", "c_nationkey", "c_custkey"), "contains", False),
            ("customer", "orders", one("orders", "o_custkey", "o_orderkey"), "calls", False),
            ("orders", "part", pairs("l_orderkey", "l_partkey"), "references", False),
            ("supplier", "part", pairs("l_suppkey", "l_partkey"), "calls", False),
        ]
        if cyclic:
            self.links_by_key += [
                ("supplier", "part", pairs("l_suppkey", "l_partkey"), "calls", True),
                ("supplier", "nation", one("supplier", "s_suppkey", "s_nationkey"), "references", False),
            ]

    def kept(self, anew: bool = False) -> Derived:
        """The graph as stored tables, which an application writes once for all its queries, each when it is first asked for.

        Ids are 64 letters that no compression shortens much, so they stand in the nodes alone. A node's number is its place in the order of ids;
        edges (`links`) are pairs of numbers, and as numbers sort like ids, operators give the same on them. `named` puts ids in their place.
        """
        self.tables = KEPT.setdefault((self.spark.sparkContext.applicationId, self.sf_dir, self.cyclic), {})
        if anew:
            self.tables.clear()
        return self

    def _put(self, name: str, make) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = make()
            released(self.spark)
        return self.tables[name]

    @property
    def store(self) -> DataFrame:
        """number, whether the row is the first of its id, id and COLUMNS, by id."""

        def make() -> DataFrame:
            ship(self.spark)
            rows = None
            for part, df in self.parts.items():
                df = df.withColumn("part", F.lit(part)).select(F.unhex("id").alias("id"), "part", "key", "node_type", "name", "file_path", "line_start", "line_end")
                rows = df if rows is None else rows.unionByName(df)
            # ids are hashes, so equal ranges of them hold equally many
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            range_ = F.floor(F.conv(F.hex(F.substring("id", 1, 3)), 16, 10).cast("long") * n / (1 << 24)).cast("int")
            rows = rows.repartitionById(n, range_).sortWithinPartitions("id")
            title = F.concat_ws(".", F.replace("file_path", F.lit("/"), F.lit(".")), F.col("name"))
            kept = rows.columns
            rows = rows.mapInArrow(_placed, f"{', '.join(f'{x.name} {x.dataType.simpleString()}' for x in rows.schema)}, place long, first boolean")
            title = F.concat_ws(".", F.replace("file_path", F.lit("/"), F.lit(".")), F.col("name"))
            rows = rows.select("place", "first", F.lower(F.hex("id")).alias("id"), *kept[1:], title.alias("title"), F.lit("").alias("signature"), F.lit("").alias("keywords"))
            rows = written(self.spark, rows, "derived-nodes")
            range_, place = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
            many = {r["p"]: r["n"] for r in rows.groupBy(range_.alias("p")).agg(F.max(place + 1).alias("n")).collect()}
            before = [0]
            for k in range(max(many, default=-1) + 1):
                before.append(before[-1] + many.get(k, 0))
            self.tables["total"] = before[-1]
            number = F.element_at(F.lit(before), (range_ + 1).cast("int")) + place
            return rows.select(number.cast("int" if before[-1] < 1 << 31 else "long").alias("number"), "first", "id", *COLUMNS)

        return self._put("nodes", make)

    def _laid(self, links: DataFrame, by: str, name: str) -> DataFrame:
        """By ranges of numbers, which are equally many, and sorted."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        total = max(1, self.store and self.tables["total"])
        kinds = sorted({x[3] for x in self.links_by_key})
        code = F.array_position(F.lit(kinds), F.col("edge_type")).cast("byte")
        dealt = links.select("source_id", "target_id", code.alias("k")).repartitionById(n, F.floor(F.col(by).cast("long") * n / total).cast("int"))
        dealt = dealt.sortWithinPartitions(by, "target_id" if by == "source_id" else "source_id")
        return written(self.spark, dealt.select("source_id", "target_id", F.element_at(F.lit(kinds), F.col("k").cast("int")).alias("edge_type")), name)

    @property
    def links(self) -> DataFrame:
        """source_id, target_id (numbers), edge_type, by source."""

        def make() -> DataFrame:
            many = {r["part"]: r["n"] for r in self.store.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
            out = None
            for a, b, keys, kind, back in self.links_by_key:
                for part, near, far in ((a, "a", "source_id"), (b, "b", "target_id")):
                    ids = self.store.where(F.col("part") == part).select(F.col("key").alias("k"), F.col("number").alias(far))
                    keys = keys.join(F.broadcast(ids) if many.get(part, 0) <= MOST_SENT else ids, F.col(near) == F.col("k")).drop("k")
                e = keys.select(*(["target_id", "source_id"] if back else ["source_id", "target_id"]), F.lit(kind).alias("edge_type")).toDF("source_id", "target_id", "edge_type")
                out = e if out is None else out.unionByName(e)
            return self._laid(out, "source_id", "derived-links")

        return self._put("links", make)

    @property
    def links_in(self) -> DataFrame:
        """The same by target."""
        return self._put("links_in", lambda: self._laid(self.links, "target_id", "derived-links-in"))

    @property
    def nodes(self) -> DataFrame:
        return self.store.select(*NODE_COLUMNS)

    @property
    def nodes_once(self) -> DataFrame:
        """The same for a query that reads them once: no table is written for it."""
        if "nodes" in self.tables:
            return self.nodes
        rows = [df.select(*NODE_COLUMNS) for df in self.parts.values()]
        return reduce(DataFrame.unionByName, rows)

    @property
    def numbered(self) -> DataFrame:
        """The nodes with their numbers for ids."""
        return self.store.select(*[F.col("number").alias("id") if c == "id" else c for c in NODE_COLUMNS])

    @property
    def edges(self) -> DataFrame:
        return self.named_links(self.links)

    @property
    def edges_in(self) -> DataFrame:
        return self.named_links(self.links_in)

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """df with ids for the numbers in some columns; as bytes until the end, as they are half as long."""
        order = df.columns
        for c in columns:
            ids = self.store.where("first").select(F.col("number").alias("_number"), F.unhex("id").alias("_id"))
            df = df.join(ids, F.col(c) == F.col("_number")).drop(c, "_number").withColumnRenamed("_id", c)
        return df.select(*[F.lower(F.hex(c)).alias(c) if c in columns else c for c in order])

    def _hubs(self) -> DataFrame | None:
        """_number, _id of targets of many edges; None if these are too many to be sent."""

        def make() -> DataFrame | None:
            often = self.links.groupBy(F.col("target_id").alias("_number")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HUB).select("_number")
            ids = self.store.where("first").select("number", F.unhex("id").alias("_id"))
            hubs = written(self.spark, often.join(ids, F.col("_number") == F.col("number")).select("_number", "_id"), "derived-hubs")
            return hubs if hubs.count() <= MOST_SENT else None

        return self._put("hubs", make)

    def named_links(self, links: DataFrame, *more: str) -> DataFrame:
        """Edges with ids, and further columns. Few rows are moved with an id in them: those of hubs get theirs where the source's is found."""
        hubs = self._hubs()
        if hubs is None:
            return self.named(links, "source_id", "target_id").select(*EDGE_COLUMNS, *more)
        number = F.broadcast(hubs.select("_number"))
        to_hubs = links.join(number, F.col("target_id") == F.col("_number"), "left_semi")
        others = links.join(number, F.col("target_id") == F.col("_number"), "left_anti")
        to_hubs = self.named(to_hubs, "source_id").join(F.broadcast(hubs), F.col("target_id") == F.col("_number")).withColumn("target_id", F.lower(F.hex("_id")))
        return to_hubs.select(*EDGE_COLUMNS, *more).unionByName(self.named(others, "source_id", "target_id").select(*EDGE_COLUMNS, *more))

    def number(self, part: str, key: int) -> int:
        """Number of one node."""
        return self.store.where((F.col("part") == part) & (F.col("key") == key)).select("number").head()[0]

    def key(self, part: str, key: int) -> str:
        """Id of one node."""
        return self.parts[part].where(F.col("key") == key).select("id").head()[0]


def sql(cyclic: bool = False) -> str:
    """CTEs `nodes`, `edges` and `keyed` (part, key, id) of the same graph."""
    node = lambda part, kind, name, path, key, source: f"SELECT '{part}' AS part, CAST({key} AS BIGINT) AS key, '{kind}' AS node_type, {name} AS name, {path} AS file_path, CAST({key} AS INTEGER) AS line_start FROM {source}"
    nat = "nation JOIN region ON n_regionkey = r_regionkey"
    parts = " UNION ALL ".join([
        node("region", "module", "r_name", "r_name || '/root'", "r_regionkey", "region"),
        node("nation", "class", "n_name", "r_name || '/' || n_name", "n_nationkey", nat),
        node("customer", "method", "c_name", "r_name || '/' || n_name || '/c'", "c_custkey", f"customer JOIN {nat} ON c_nationkey = n_nationkey".replace("JOIN nation JOIN region ON n_regionkey = r_regionkey ON c_nationkey = n_nationkey", "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")),
        node("orders", "function", "'order' || o_orderkey", "r_name || '/' || n_name || '/c/o'", "o_orderkey", "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
        node("supplier", "function", "s_name", "r_name || '/' || n_name || '/s'", "s_suppkey", "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
        node("part", "variable", "p_name", "'parts/' || p_brand", "p_partkey", "part"),
    ])
    links = [
        ("region", "nation", "SELECT n_regionkey AS a, n_nationkey AS b FROM nation", "defines"),
        ("nation", "customer", "SELECT c_nationkey AS a, c_custkey AS b FROM customer", "contains"),
        ("customer", "orders", "SELECT o_custkey AS a, o_orderkey AS b FROM orders", "calls"),
        ("orders", "part", "SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem", "references"),
        ("supplier", "part", "SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem", "calls"),
    ]
    if cyclic:
        links += [("part", "supplier", "SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem", "calls"), ("supplier", "nation", "SELECT s_suppkey AS a, s_nationkey AS b FROM supplier", "references")]
    edges = " UNION ALL ".join(f"SELECT s.id AS source_id, d.id AS target_id, '{kind}' AS edge_type FROM ({keys}) x JOIN keyed s ON s.part = '{a}' AND s.key = x.a JOIN keyed d ON d.part = '{b}' AND d.key = x.b" for a, b, keys, kind in links)
    return f"""base AS ({parts}),
keyed AS MATERIALIZED (SELECT *, sha256(node_type || ':' || file_path || ':' || name || ':' || line_start) AS id FROM base),
nodes AS (SELECT id, node_type, name, replace(file_path, '/', '.') || '.' || name AS title, file_path, line_start, line_start + 10 AS line_end, '' AS signature, '' AS keywords FROM keyed),
edges AS MATERIALIZED ({edges})"""
