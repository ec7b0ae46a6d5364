"""What the operators of this subpackage share: tables, splits, durable intermediate tables, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def id_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only where it is unset, a folder of this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(top)
    return top


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = kept_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for what lasts as long as the program."""
    if not _WRITTEN:
        atexit.register(lambda: [remove(spark, p) for p in list(_WRITTEN)])
    _WRITTEN.append(f"{shared_dir(spark)}/{name}")
    return _WRITTEN[-1]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Tables that written() made; they go at the end of the program, or by remove() before.
_WRITTEN: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table that written() made; one that is gone, or whose session has ended, is passed over."""
    if path in _WRITTEN:
        _WRITTEN.remove(path)
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def last_written() -> str:
    return _WRITTEN[-1]


def by_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df through f in Python workers; what a task has freed goes back to the system at its end, since a worker lives on through later stages."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: that of Arrow, and of the C library where it can (glibc)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about so many bytes together; a longer text stands alone."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, n, total = 0, len(size), 0
    for k in range(n):
        if total and total + size[k] > most:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += int(size[k])
    if at < n:
        yield batch.slice(at, n - at)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts as str; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts as UTF-8; null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


class Index(dict):
    """Numbers new keys on."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Lookup:
    """Places of 64-bit keys in a table with open addressing; -1 for keys that it lacks."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.mask = np.uint64((1 << max(4, int(4 * len(keys)).bit_length())) - 1)
        self.table = np.full(int(self.mask) + 1, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = (keys[left] + np.uint64(step)) & self.mask
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            left, step = left[self.table[slot] != left], step + 1
        self.steps = step

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for step in range(self.steps):
            got = self.table[(keys[left] + np.uint64(step)) & self.mask]
            used = got >= 0
            left, got = left[used], got[used]
            same = self.keys[got] == keys[left]
            out[left[same]] = got[same]
            left = left[~same]
            if not len(left):
                break
        return out


def kept(df: DataFrame, start: Callable[[], object], keep: Callable[[object, list[str]], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of df whose texts keep() marks, all columns as they are; start() makes what a task carries along. No shuffle."""

    def run(batches):
        state = start()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for b in pieces(batch, text_col):
                mask = keep(state, [x or "" for x in b.column(at).to_pylist()])
                yield b.filter(pa.array(mask, pa.bool_()))

    return by_arrow(df, run, df.schema)
