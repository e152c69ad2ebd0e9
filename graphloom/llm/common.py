"""Shared helpers: Arrow text buffers as numpy arrays, shipping, scratch tables."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators everywhere in this subpackage: ASCII blank and \t to \r.
WORD = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context (they may lack it)."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(), "graphloom_pkg.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for top, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(top, name)
                        out.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
        sc.addPyFile(path)
    sc._graphloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it is unset: a folder of this machine if Spark runs on this machine alone, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{os.path.join(tempfile.gettempdir(), 'graphloom-checkpoints')}"
    return path.rstrip("/")


#: Scratch tables of this process that are still there, oldest first.
_TABLES: list[str] = []


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes within go when each write ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def scratch_table(df: DataFrame, name: str, *, end_shuffles: bool = False) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    with shuffles_end(spark) if end_shuffles else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """scratch_table, its rows dealt into files by a hash of the column: grouping by it shuffles nothing more."""
    spark = df.sparkSession
    unique = uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/graphloom-{name}-{unique}", f"graphloom_{name}_{unique}"
    _TABLES.append(path)
    with shuffles_end(spark):
        df.write.bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  resolved before its name goes
    spark.sql(f"DROP TABLE {table}")  # the files stay
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_scratch(df: DataFrame) -> None:
    """Delete a scratch table that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/graphloom-" in path:
            _delete(df.sparkSession, path)
            name = path.rsplit("/", 1)[1]
            _TABLES[:] = [x for x in _TABLES if not x.endswith(name)]


def drop_tables(spark: SparkSession, paths: list[str], *, unread: DataFrame) -> list[str]:
    """Delete those of the scratch tables that are still there and that the DataFrame doesn't read; the others."""
    used = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in unread.inputFiles() if "/graphloom-" in f}
    gone = [x for x in paths if x in _TABLES and x.rsplit("/", 1)[1] not in used]
    for path in gone:
        _delete(spark, path)
    _TABLES[:] = [x for x in _TABLES if x not in gone]
    return [x for x in paths if x in _TABLES]


def tables_since(mark: int) -> list[str]:
    return _TABLES[mark:]


def scratch_mark() -> int:
    return len(_TABLES)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no live plan reads; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1, ...: names of any kind then clash with nothing."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def chosen(df: DataFrame, **names: str) -> DataFrame:
    """Columns of df under new names, found by place: chosen(df, text="body")."""
    return numbered(df).select(*[F.col(f"c{df.columns.index(old)}").alias(new) for new, old in names.items()])


def map_rows(df: DataFrame, fn) -> DataFrame:
    """df through fn, which keeps the columns as they are; fn sees them as c0, c1, ..."""
    d = numbered(df)
    return map_arrow(d, fn, d.schema).toDF(*df.columns)


def id_crc(col: str | Column) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def _libc():
    """The C library, if it is one whose heap can be told to give memory back."""
    try:
        lib = ctypes.CDLL(None)
        return lib if hasattr(lib, "mallopt") and hasattr(lib, "malloc_trim") else None
    except OSError:
        return None


@contextmanager
def lean() -> Iterator[None]:
    """The process gives freed memory back: large arrays at once, the rest at the end."""
    lib = _libc()
    if lib is not None:
        lib.mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD: arrays of 4 MB or more are pages of their own
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        if lib is not None:
            lib.malloc_trim(0)


def hand_back(fn):
    """fn, a function of batches, in a worker that gives freed memory back when the task ends."""

    def run(batches):
        with lean():
            yield from fn(batches)

    return run


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(hand_back(fn), schema)


class Texts:
    """Some texts as one byte array; doc i is data[starts[i]:ends[i]]."""

    __slots__ = ("data", "ends", "first", "null", "starts")

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, null: np.ndarray, first: int):
        self.data, self.starts, self.ends, self.null, self.first = data, starts, ends, null, first

    def __len__(self) -> int:
        return len(self.starts)

    def raw(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the number of words of each doc; no word crosses a doc's end."""
        data = self.data if data is None else data
        solid = ~IS_SPACE[data]
        n = len(solid)
        if n == 0:
            z = np.zeros(0, dtype=np.int64)
            return z, z, np.zeros(len(self), dtype=np.int64)
        full = self.ends > self.starts
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = solid[:-1]
        before[self.starts[full]] = False
        begin = np.flatnonzero(solid & ~before)
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = solid[1:]
        after[self.ends[full] - 1] = False
        end = np.flatnonzero(solid & ~after) + 1
        count = np.searchsorted(begin, self.ends) - np.searchsorted(begin, self.starts)
        return begin, end, count


def text_blocks(column: pa.Array, target: int = (1 << 20) - 8) -> Iterator[Texts]:
    """Split an Arrow string column into runs of docs of about target bytes (a longer doc stands alone)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    null = ~np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1
        j = min(max(j, i + 1), n)
        lo, hi = offsets[i], offsets[j]
        yield Texts(body[lo:hi], offsets[i:j] - lo, offsets[i + 1 : j + 1] - lo, null[i:j], i)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        out = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.ones(size, dtype=np.uint64)
            have, step = 1, b
            while have < size:
                p[have : 2 * have] = p[:have] * np.uint64(step)
                have, step = 2 * have, step * step % 2**64
            out.append(p)
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


class RollingHash:
    """Polynomial hash of any byte range of data modulo 2**64, by prefix sums; equal bytes, equal hash."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sum = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.sum[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sum[end] - self.sum[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte offset."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def repeat_ranges(count: np.ndarray) -> np.ndarray:
    """0..count[0]-1, 0..count[1]-1, ..."""
    total = int(count.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(count) - count, count)
