"""Helpers that the corpus operators share: staging, byte blocks and vectorised hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-casing of A-Z only, as the shingle contracts ask for.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


#: Bytes of an Arrow batch between Spark and Python that ``small_batches`` sets.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may be without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of the frames is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts lineage, so that a lost executor costs a re-read and not the work before it, and
    lets two consumers share one computation. Nothing refers to the shuffles behind it any more; a
    collection in the driver lets Spark's cleaner remove their files now and not some time later.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> str:
    """The name of a table of ``df`` in the warehouse, in buckets by ``key``: joins on it do not deal it again."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table_name = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).saveAsTable(table_name)
    spark.sparkContext._jvm.System.gc()
    return table_name


def small_batches(spark: SparkSession) -> None:
    """From here on the session's jobs pass rows to Python in batches of about ``BATCH_BYTES``, not of up to 64 MB of text.

    A query is run after the function that made it returned, so the setting stays with the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def as_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, ``id`` and ``body``: the text as UTF-8 bytes, null as empty."""
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"),
    )


def text_of(body: bytes) -> str:
    return body.decode("utf-8", "replace")


def blocks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes]]]:
    """Consecutive rows of (id, body) in groups of about ``limit`` bytes; a longer body stands alone."""
    ids: list = []
    bodies: list[bytes] = []
    held = 0
    for batch in batches:
        for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bodies and held + len(body) > limit:
                yield ids, bodies
                ids, bodies, held = [], [], 0
            ids.append(i)
            bodies.append(body)
            held += len(body)
    if bodies:
        yield ids, bodies


def tidy() -> None:
    """Gives memory back at a task's end: the Python worker stays for other tasks, and what it holds counts against its executor."""
    Rolling.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable) -> Callable:
    """``run``, a function that yields from an iterator of batches, with ``tidy`` after it."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def by_block(
    df: DataFrame, work: Callable[[list, list[bytes]], pa.RecordBatch], schema: str, limit: int
) -> DataFrame:
    """Applies ``work`` to blocks of rows of (id, body), inside the tasks that read them."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in blocks(batches, limit):
            yield work(ids, bodies)

    return df.mapInArrow(run, schema)


def squeeze(bodies: list[bytes]) -> pa.Array:
    """Byte strings compressed one by one, each after its length."""
    return pa.array([len(b).to_bytes(8, "little") + pa.compress(b, codec="zstd", asbytes=True) for b in bodies], pa.binary())


def loose(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def slices(batch: pa.RecordBatch, columns: list[str], limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose compressed ``columns`` hold about ``limit`` bytes when loose; a larger row stands alone."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        sizes += [int.from_bytes(b[:8], "little") for b in batch.column(c).to_pylist()]
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if batch.num_rows > begin:
        yield batch.slice(begin)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of any substrings of a byte array, position independent."""

    BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        powers, self.inverse = self._tables(n + 1, which)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.sums[1:])

    @classmethod
    def forget(cls) -> None:
        cls._powers.clear()

    @classmethod
    def _tables(cls, n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        held = cls._powers.get(which)
        if held is None or len(held[0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            base = int(cls.BASES[which])
            tables = []
            for factor in (base, pow(base, -1, 1 << 64)):
                t = np.full(size, factor, np.uint64)
                t[0] = 1
                tables.append(np.cumprod(t))
            held = (tables[0], tables[1])
            if size <= 1 << 20:
                cls._powers[which] = held
        return held

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], elementwise."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def every(self, length: int) -> np.ndarray:
        """Hashes of all windows of one length."""
        m = len(self.sums) - length
        return (self.sums[length:] - self.sums[:m]) * self.inverse[:m]
