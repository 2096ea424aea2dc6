"""Files of arrays, their migration, and batches of matrices."""

import numpy as np
import pyarrow as pa
import pytest

from tickloom.sources import arrays


def test_npz_to_parquet(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    ts = np.arange(5, dtype=np.int64)
    np.savez(tmp_path / "in" / "a.npz", timestamp_ns=ts, bid=ts / 2, f=np.ones((5, 3), np.float32))
    np.savez(tmp_path / "in" / "deep" / "b.npz", timestamp_ns=ts + 10, bid=ts / 4)
    np.savez(tmp_path / "in" / "empty.npz", timestamp_ns=ts[:0], bid=ts[:0] / 2)
    found = arrays.read_arrays(spark, str(tmp_path / "in"), "timestamp_ns long, bid double, f array<float>")
    rows = sorted((r["timestamp_ns"], r["bid"], r["f"]) for r in found.collect())
    assert rows == [(int(t), t / 2, [1.0] * 3) for t in ts] + [(int(t) + 10, t / 4, None) for t in ts]
    arrays.to_parquet(found, str(tmp_path / "out"))
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.columns == ["timestamp_ns", "bid", "f"] and again.count() == 10
    np.save(tmp_path / "one.npy", np.array([1.5, 2.5]))
    assert [r["x"] for r in arrays.read_arrays(spark, str(tmp_path / "one.npy"), "x double").collect()] == [1.5, 2.5]


def test_odd_arrays_are_refused(spark, tmp_path):
    np.savez(tmp_path / "a.npz", u=np.arange(3.0), v=np.arange(2.0))
    with pytest.raises(Exception, match="several lengths"):
        arrays.read_arrays(spark, str(tmp_path), "u double, v double").collect()


def test_batches(spark, tmp_path):
    spark.range(2500).selectExpr("float(id) as f_0", "float(-id) as f_1", "double(id) as var", "int(id % 2) as label", "'x' as other").repartition(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))

    def work(matrix, rest):
        assert matrix.dtype == np.float32 and (matrix[:, 0] == -matrix[:, 1]).all() and (rest["var"] == matrix[:, 0]).all()
        return pa.RecordBatch.from_arrays([pa.array([len(matrix)]), pa.array([float(matrix[:, 0].sum())]), pa.array([int(rest["label"].sum())])], ["n", "total", "ones"])

    found = arrays.in_batches(table, ["f_0", "f_1"], ["var", "label"], work, "n long, total double, ones long", rows=400)
    rows = found.collect()
    assert sorted(r["n"] for r in rows) == [100, *[400] * 6] and sum(r["total"] for r in rows) == sum(range(2500)) and sum(r["ones"] for r in rows) == 1250
    assert "other" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["n"] for r in arrays.in_batches(table, ["f_0", "f_1"], ["var", "label"], work, "n long, total double, ones long", rows=400, most=2).collect()] == [400, 400]
