"""Streams: each micro-batch is merged into a table, keys that come again replace their row, and a batch that comes again changes nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.merge import keep_last
from textloom.sources.tables import exists

#: Versions that stay, so that readers of an older one can end; batches that are kept apart before they are merged into a new version.
KEPT, APART = 3, 16


class VersionedTable:
    """A Parquet table in numbered versions (v-) and, after the newest one, batches (d-) that readers merge into it by key.

    A version or batch counts once it was written to its end, so it is there as a whole or not at all, whatever breaks off; readers keep
    theirs while a new one is written. A small batch costs only its own rows: the table is written anew after APART of them. One job at a time writes.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _parts(self) -> list[tuple[int, str, bool]]:
        """Number and name of each version and batch, in order, and whether it was written to its end."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        return sorted((int(n.split("-")[1]), n, exists(self.spark, f"{self.path}/{n}/_SUCCESS")) for n in names if n[:2] in ("v-", "d-"))

    def _current(self) -> tuple[str | None, list[str]]:
        """The newest whole version, and the whole batches after it."""
        whole = [(k, n) for k, n, done in self._parts() if done]
        at, version = max(((k, n) for k, n in whole if n.startswith("v-")), default=(0, None))
        return version, [n for k, n in whole if k > at and n.startswith("d-")]

    def version(self) -> str | None:
        return self._current()[0]

    def read(self) -> DataFrame | None:
        version, batches = self._current()
        found = [self.spark.read.parquet(f"{self.path}/{n}") for n in ([version] if version else []) + batches]
        if not found:
            return None
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
        if not batches:
            return whole
        key, order = self.spark.read.parquet(f"{self.path}/_merge").first()
        return keep_last(whole, key, [F.col("__batch"), F.col(order)])

    def replace(self, df: DataFrame) -> None:
        there = self._parts()
        number = 1 + max((k for k, *_ in there), default=0)
        df.write.parquet(f"{self.path}/v-{number:012d}")
        kept = sorted([number, *(k for k, n, done in there if done and n.startswith("v-"))])[-KEPT:]
        for k, n, done in there:
            if not done or k < kept[0]:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def append(self, batch: DataFrame, key: str, order_col: str) -> None:
        """A batch with __batch, its number; of a key the row of the last batch counts, in a batch the last by order_col."""
        if not exists(self.spark, f"{self.path}/_merge/_SUCCESS"):
            self.spark.createDataFrame([(key, order_col)], "key string, order_col string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_merge")
        number = 1 + max((k for k, *_ in self._parts()), default=0)
        batch.write.parquet(f"{self.path}/d-{number:012d}")
        if len(self._current()[1]) >= APART:
            self.replace(self.read())


def merge_batch(table: VersionedTable, batch: DataFrame, batch_id: int, key: str, order_col: str) -> None:
    """Rows of the batch replace those of the same key, the last one by order_col in each batch. A batch that comes again changes nothing."""
    table.append(keep_last(batch.withColumn("__batch", F.lit(batch_id).cast("long")), key, [F.col(order_col)]), key, order_col)


def upsert_stream(stream: DataFrame, table: VersionedTable, key: str, order_col: str, checkpoint: str) -> StreamingQuery:
    """Merges all that is there now, in micro-batches, and stops; run again, it goes on where it stood."""
    return stream.writeStream.foreachBatch(lambda b, i: merge_batch(table, b, i, key, order_col)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time_col: str, width: str, late: str, *keys: str) -> DataFrame:
    """An addition: rows in each window of event time and group; rows later than the watermark are left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def status_table(progress: DataFrame) -> DataFrame:
    """Of each tag the last status that was recorded, for taking up work again."""
    return keep_last(progress, "tag", F.col("at"))
