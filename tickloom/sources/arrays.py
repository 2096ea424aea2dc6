"""Files of numpy arrays as tables, their migration to Parquet, and tables as batches of matrices."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Rows that a file gives at once.
SLICE = 100_000


def read_arrays(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Rows of ``.npz`` or ``.npy`` files below ``path``, with ``file``: columns are the arrays of their names, all of one length.

    A ``.npy`` file is one column, the first of ``columns`` (DDL). A file is read in one task, which gives its rows in slices.
    A missing array is null; pickled arrays are refused.
    """
    schema = StructType.fromDDL(columns)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                held = np.load(io.BytesIO(content), allow_pickle=False)
                arrays = {schema.names[0]: held} if isinstance(held, np.ndarray) else {n: held[n] for n in schema.names if n in held.files}
                n = max((len(a) for a in arrays.values()), default=0)
                if any(len(a) != n for a in arrays.values()):
                    raise ValueError(f"arrays of {name} have several lengths")
                for at in range(0, n, SLICE):
                    part = {c: a[at : at + SLICE] for c, a in arrays.items()}
                    size = min(SLICE, n - at)
                    found = {f.name: (list(part[f.name]) if isinstance(f.dataType, ArrayType) else part[f.name]) if f.name in part else [None] * size for f in schema.fields}
                    yield pd.DataFrame({"file": [name] * size, **found})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.np[yz]").load(path)
    return files.select("path", "content").mapInPandas(rows, f"file string, {columns}")


def to_parquet(arrays: DataFrame, path: str, by: str | None = None) -> None:
    """Writes ``read_arrays`` as Parquet, in folders by ``by``."""
    writer = arrays.drop("file").write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)


def in_batches(df: DataFrame, features: list[str], others: list[str], work: Callable[[np.ndarray, dict[str, np.ndarray]], pa.RecordBatch], schema: str, rows: int = 1024, most: int | None = None) -> DataFrame:
    """What ``work`` makes of batches of ``rows`` rows: a float32 matrix of the features, and the other columns by name.

    Batches are cut inside the tasks that scan the table, each task's last one being shorter, and only these columns are read.
    ``most`` ends each task after so many batches, as a validation on part of the data does.
    """

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = given = 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal held, size
            whole = pa.Table.from_batches(held).combine_chunks()
            rest = whole.slice(n)
            held, size = rest.to_batches(), rest.num_rows
            part = whole.slice(0, n)
            column = lambda c: part[c].to_numpy(zero_copy_only=False)
            matrix = np.column_stack([column(c).astype(np.float32) for c in features]) if features else np.zeros((n, 0), np.float32)
            return work(matrix, {c: column(c) for c in others})

        for part in parts:
            held.append(part)
            size += part.num_rows
            while size >= rows and (most is None or given < most):
                given += 1
                yield cut(rows)
            if most is not None and given >= most:
                return
        if size and (most is None or given < most):
            yield cut(size)

    return df.select(*(F.col(c) for c in [*features, *others])).mapInArrow(go, schema)
