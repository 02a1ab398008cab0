"""Source trees as tables: discovery, content hashes, texts, dependency files."""

from __future__ import annotations

import json
import re
import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.shipping import ship

#: Folders that are never looked into, beside those whose name starts with a dot.
SKIPPED = ("__pycache__", "node_modules", "venv", "dist", "build")
SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".go", ".rs")


def _relative(path: Column, root: str) -> Column:
    bare = F.regexp_replace(path, r"^[a-z]+:/*(?=/)", "")
    return F.regexp_replace(bare, "^" + re.escape(re.sub(r"^[a-z]+:/*(?=/)", "", root).rstrip("/")) + "/", "")


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """file_path (relative), content_hash, content of each source file under root. Files that vanish or cannot be read are passed over."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    rows = raw.select(_relative(F.col("path"), root).alias("file_path"), "content")
    folders = F.slice(F.split("file_path", "/"), 1, F.size(F.split("file_path", "/")) - 1)
    hidden = F.exists(folders, lambda x: x.startswith(".") | x.isin(*SKIPPED))
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.col("file_path").endswith(s)
    return rows.where(~hidden & wanted).select("file_path", F.sha2("content", 256).alias("content_hash"), "content")


def texts_of(spark: SparkSession, root: str, paths: DataFrame, most_listed: int = 1000) -> DataFrame:
    """file_path, content_hash, text of the files under root that `paths` (file_path) names. A few are read by name, else all are looked at."""
    n = paths.count()
    if n == 0:
        return spark.createDataFrame([], "file_path string, content_hash string, text string")
    if n > most_listed:
        return decoded(discover(spark, root).join(paths, "file_path", "left_semi"))
    names = [f"{root.rstrip('/')}/{_escaped(r['file_path'])}" for r in paths.collect()]
    raw = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(names)
    return decoded(raw.select(_relative(F.col("path"), root).alias("file_path"), F.sha2("content", 256).alias("content_hash"), "content"))


def _escaped(path: str) -> str:
    """A path in which Spark's file names take no character for a pattern."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", path)


def decoded(files: DataFrame) -> DataFrame:
    """file_path, content_hash, text: UTF-8 with a replacement mark for what is malformed."""
    ship(files.sparkSession)

    def each(batches):
        for b in batches:
            texts = [x.decode("utf-8", "replace") if x is not None else None for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["file_path", "content_hash", "text"])

    return files.select("file_path", "content_hash", "content").mapInArrow(each, "file_path string, content_hash string, text string")


def dependencies(name: str, text: str) -> set[str]:
    """Package names of one requirements.txt, pyproject.toml or package.json; none if it cannot be read."""
    bare = lambda x: re.split(r">=|==|\[|;|<|~|!| ", x.strip())[0].strip().lower()
    try:
        if name.endswith("requirements.txt"):
            return {bare(x) for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "-"))} - {""}
        if name.endswith("pyproject.toml"):
            doc = tomllib.loads(text)
            poetry = doc.get("tool", {}).get("poetry", {}).get("dependencies", {})
            return ({bare(x) for x in doc.get("project", {}).get("dependencies", [])} | {k.lower() for k in poetry}) - {"", "python"}
        if name.endswith("package.json"):
            doc = json.loads(text)
            return {k for part in ("dependencies", "devDependencies", "peerDependencies") for k in doc.get(part, {})}
    except (ValueError, AttributeError):
        pass
    return set()


def installed(spark: SparkSession, root: str) -> set[str]:
    """Names of the packages in a virtual environment under root."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path(f"{root.rstrip('/')}/{{.venv,venv}}/{{Lib,lib,lib/python*}}/site-packages/*"))
    return {x.getPath().getName().lower().split("-")[0] for x in found or []}


#: Extensions that front-end plugins register: name of the package they serve -> what makes their rules.
PLUGINS: dict[str, object] = {}


def load_plugins(names: set[str]) -> list:
    """Rules of the registered plugins whose package is among the dependencies; one that fails to load is passed over."""
    out = []
    for package in sorted(PLUGINS):
        if package in names:
            try:
                out.append(PLUGINS[package]())
            except Exception:  # noqa: BLE001  a broken plugin must not stop an index
                continue
    return out
