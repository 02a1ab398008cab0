"""Builds that follow a source tree: a stream tells when to look, and each micro-batch runs one incremental build.

The manifest makes builds idempotent, so a micro-batch that is run again after a failure changes nothing. A file stream tells of new files
alone; with `every` a clock stream starts a build at each tick, which sees changed and deleted files as well (an unchanged tree ends the
build at once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.engine import Engine
from graphloom.sources.files import SUFFIXES


def watch(engine: Engine, root: str, checkpoint: str, pattern: str = "*{" + ",".join(SUFFIXES) + "}", every: str | None = None, **options) -> StreamingQuery:
    """Starts a query that re-indexes root: whenever files under it that match the pattern come, up to what is there now; or, with `every`
    (such as "1 minute"), at each tick until it is stopped."""

    def batch(found: DataFrame, _number: int) -> None:
        if every or not found.isEmpty():
            engine.index(root, **options)

    if every:
        return engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    files = engine.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
