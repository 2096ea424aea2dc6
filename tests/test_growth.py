"""Queries over ticks where symbols are long or values extreme: against their SQL, and against plain versions."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.plans import catalogue, tick_queries


def duck(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con.execute(catalogue.oracle_sql()[name]).fetchall()


def test_hmm_filter_beyond_its_densities(spark, data, tmp_path):
    """A value of which no density is left: the SQL has NaN from there on."""
    events = spark.read.parquet(f"{data}/events.parquet")
    events.withColumn("value", F.when(F.col("event_id") == 500, 900.0).otherwise(F.col("value"))).write.parquet(f"{tmp_path}/events.parquet")
    wanted = {r[:2]: r[2:] for r in duck(tmp_path, "hmm_filter")}
    found = {(r["symbol"], r["seq"]): (r["p_0"], r["p_1"]) for r in tick_queries.hmm_filter(spark, str(tmp_path)).collect()}
    assert found.keys() == wanted.keys() and sum(np.isnan(v[0]) for v in wanted.values()) == 99
    for k, v in wanted.items():
        np.testing.assert_array_equal(np.array(found[k], float), np.array(v))


LONG = ["tib_window", "vol_ratio", "realised_variance", "triple_barrier", "risk_window", "rank_ic", "log_returns"]


@pytest.fixture(scope="module")
def flat(spark, data, tmp_path_factory):
    """Events with long runs of one value, over days, and some that share their time."""
    folder = tmp_path_factory.mktemp("flat")
    events = spark.read.parquet(f"{data}/events.parquet")
    many = events.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumns({
        "event_id": F.col("event_id") + 1000 * F.col("k"), "ts": F.col("ts") + F.make_dt_interval(days=9 * F.floor(F.col("k") / 2).cast("int")),
        "value": F.when(F.col("event_id") % 400 < 150, 42.0).otherwise(F.col("value")), "event_type": F.when(F.col("event_id") < 700, "view").otherwise(F.col("event_type")),
    }).drop("k")
    many.write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", LONG)
def test_no_task_holds_a_symbol(spark, flat, name):
    found = catalogue.queries()[name](spark, flat)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\((symbol|event_type)#\d+, (timestamp_ns|mid|y|__x|__y)#", plan)
    rows, wanted = sorted(map(tuple, found.collect())), sorted(duck(flat, name))
    assert len(rows) == len(wanted) > 0
    for a, b in zip(rows, wanted, strict=True):
        assert a == pytest.approx(b, abs=1.1e-6)


def test_feature_vector_runs_its_recurrences_once(spark, flat):
    plan = catalogue.queries()["feature_vector"](spark, flat)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
