"""A graph in Parquet under one folder. Each build writes the tables that changed into a folder of its own, and a numbered pointer file
then names the folder of every table; the highest number counts.

Spark has no transaction over several tables; here readers see the tables that one pointer names. A pointer is never changed or taken
away by a build, so a build that dies midway changes nothing, and of two builds at once one fails. All access goes through Spark's file
systems.

Tables are laid out for what is looked up: nodes by id, edges by source and once more by target, postings by token, each dealt by ranges
and sorted, so a scan for a few values skips most of it.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schemas

TABLES = {
    "nodes": schemas.NODES,
    "edges": schemas.EDGES,
    "edges_in": schemas.EDGES,
    "raw_edges": schemas.EDGES,
    "stubs": schemas.NODES,
    "embeddings": schemas.EMBEDDINGS,
    "manifest": schemas.MANIFEST + ", root string",
    "snapshot": schemas.SNAPSHOT,
    "postings": "token string, id string, length int, title array<int>, keywords array<int>",
    "lengths": "id string, length int",
    "meta": "key string, value string",
}
#: What a table is dealt and sorted by.
ORDER = {"nodes": "id", "stubs": "id", "edges": "source_id", "raw_edges": "source_id", "edges_in": "target_id", "embeddings": "node_id", "postings": "token", "lengths": "id"}
VERSION = 2
POINTER = re.compile(r"CURRENT-(\d{10})")


#: Opened stores by application and folder.
OPEN: dict[tuple[str, str], GraphStore] = {}


class ConflictingWrite(RuntimeError):
    """Another build has written a version meanwhile."""


class Version:
    """Tables of a version in the making; the others are carried over as they are."""

    def __init__(self, store: GraphStore):
        self.store, self.number, self.tables = store, *store.pointer()
        self.number += 1
        self.tables = dict(self.tables)
        self.folder = f"v-{self.number}-{uuid.uuid4().hex}"

    def put(self, table: str, df: DataFrame) -> DataFrame:
        """Writes a table and returns it as read; edges are written by source and by target."""
        if table == "edges":
            df = self._write(table, df)
            self._write("edges_in", df)
            return df
        return self._write(table, df)

    def _write(self, table: str, df: DataFrame) -> DataFrame:
        columns = [x.split()[0] for x in TABLES[table].split(", ")]
        df = df.select(*columns)
        if table in ORDER:
            df = df.repartitionByRange(ORDER[table]).sortWithinPartitions(ORDER[table])
        path = f"{self.folder}/{table}"
        df.write.parquet(f"{self.store.path}/{path}")
        self.tables[table] = path
        return self.store.at(table, path)

    def commit(self) -> None:
        if "meta" not in self.tables:
            self._write("meta", self.store.spark.createDataFrame([("schema_version", str(VERSION))], TABLES["meta"]))
        self.store.point(self.number, self.tables)


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        at = self._path(self.path)
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(m[1]) for m in map(POINTER.fullmatch, names) if m)

    def pointer(self) -> tuple[int, dict[str, str]]:
        """Number of the version that readers see, and the folder of each of its tables; 0 and none before the first build."""
        numbers = self._pointers()
        if not numbers:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/CURRENT-{numbers[-1]:010d}", wholetext=True).head()[0]
        found = json.loads(text)
        if found["schema_version"] > VERSION:
            raise RuntimeError(f"the graph at {self.path} was written by a later version")
        return numbers[-1], found["tables"]

    def point(self, number: int, tables: dict[str, str]) -> None:
        """Makes a version the current one. The pointer is written aside and then named, so nobody reads half of it."""
        aside, final = self._path(f"{self.path}/.pointer-{uuid.uuid4().hex}"), self._path(f"{self.path}/CURRENT-{number:010d}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps({"schema_version": VERSION, "tables": tables}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise ConflictingWrite(f"version {number} of {self.path} exists")

    def current(self) -> int | None:
        """The version that readers see."""
        return (self._pointers() or [None])[-1]

    def begin(self) -> Version:
        return Version(self)

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None) -> GraphStore:
        """The store of a folder that holds a graph, one object a folder and application; without a path, of the folder that GRAPHLOOM_STORE
        names, else of `.graphloom` here."""
        path = path or os.environ.get("GRAPHLOOM_STORE") or ".graphloom"
        key = (spark.sparkContext.applicationId, path)
        store = OPEN.get(key) or cls(spark, path)
        if store.current() is None:
            OPEN.pop(key, None)
            raise FileNotFoundError(f"no graph at {path}")
        OPEN[key] = store
        return store

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[table])

    def at(self, table: str, path: str) -> DataFrame:
        """A written table. Columns that an older version lacks are filled with ''."""
        df = self.spark.read.parquet(f"{self.path}/{path}")
        for part in TABLES[table].split(", "):
            name, kind = part.split()[:2]
            if name not in df.columns:
                df = df.withColumn(name, F.lit("" if kind == "string" else None).cast(kind))
        return df.select(*[x.split()[0] for x in TABLES[table].split(", ")])

    def read(self, table: str) -> DataFrame:
        """A table of the current version."""
        tables = self.pointer()[1]
        return self.at(table, tables[table]) if table in tables else self.empty(table)

    def write(self, **tables: DataFrame) -> int:
        """A new version with these tables; the others are carried over."""
        version = self.begin()
        for name, df in tables.items():
            version.put(name, df)
        version.commit()
        return version.number

    def prune(self) -> None:
        """Removes pointers but the current one, and tables that it doesn't name."""
        number, tables = self.pointer()
        for k in self._pointers():
            if k < number:
                self._fs.delete(self._path(f"{self.path}/CURRENT-{k:010d}"), False)
        for s in self._fs.listStatus(self._path(self.path)):
            if s.getPath().getName().startswith("v-"):
                left = 0
                for t in self._fs.listStatus(s.getPath()):
                    if f"{s.getPath().getName()}/{t.getPath().getName()}" in tables.values():
                        left += 1
                    else:
                        self._fs.delete(t.getPath(), True)
                if not left:
                    self._fs.delete(s.getPath(), True)

    def clear(self) -> None:
        """All tables empty; meta stays."""
        number, tables = self.pointer()
        self.point(number + 1, {k: v for k, v in tables.items() if k == "meta"})

    def snapshot(self):
        """The snapshot's row, or None."""
        rows = self.read("snapshot").take(1)
        return rows[0] if rows else None

    def exists(self, node: str) -> bool:
        return not self.read("nodes").where(F.col("id") == node).isEmpty()

    def get(self, node: str):
        rows = self.read("nodes").where(F.col("id") == node).take(1)
        if not rows:
            raise KeyError(node)
        return rows[0]
