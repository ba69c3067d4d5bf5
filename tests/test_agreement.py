"""Queries beside their SQL twins, or plain Python, on small tables that once told them apart."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from footfall.operators import accuracy, areas
from footfall.plans import barriers, graphs, scoring, streams
from footfall.streaming import timed
from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"


def _beside(spark, folder, tables, module, name):
    """The rows of a query over a few tables, after a look at what its SQL says of them."""
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = connect(SF)
    for table in tables:
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    ours = module.QUERIES[name](spark, str(folder)).toPandas()
    assert_same(ours, con.execute(module.SQL[name]).df())
    return ours


def test_connectors_beside_a_pool_stay_dry(spark, tmp_path):
    # Place 26 is up and left of the pool of place 5520, where one of its sides alone begins within 200 m of it.
    near = spark.range(15_000).filter("id IN (26, 5520)")
    rows = near.select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit("m").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"), F.lit(1).alias("c_nationkey"))
    got = _beside(spark, tmp_path, {"customer": rows}, barriers, "blocked_connectors")
    assert dict(zip(got["id"], got["wet_m"] > 0, strict=True)) == {26: False, 5520: True}


def test_component_of_a_path_longer_than_any_bound(spark, tmp_path):
    # A snake over a grid 50 wide: every other row is open, and one node at alternate ends joins two of them.
    open_ = F.expr("(id DIV 50) % 2 = 0 OR id % 50 = IF((id DIV 50) % 4 = 1, 49, 0)")
    rows = spark.range(1_050).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.when(open_, 5).otherwise(1).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    got = _beside(spark, tmp_path, {"part": rows}, graphs, "component_sizes")
    assert got.values.tolist() == [[0, 560]]


def test_no_gap_is_an_area_of_nothing(spark):
    none = spark.createDataFrame([], "level int, ix long, iy long, area_m2 double")
    assert [tuple(r) for r in areas.union_gap_area(none).collect()] == [(0.0, 0)]
    assert "union_gap_area" in scoring.SQL


def test_streams_do_not_hang_on_the_size_of_frames(spark, tmp_path):
    # One user's events in any order, over many frames of one micro-batch.
    kinds, n = ["error", "view", "error", "click"], 200
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=(i * 37) % 90), 1, kinds[i * i % 7 % 4], float(i * 53 % 97) / 2, "") for i in range(n)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for name in ("budget_gate", "cache_reads", "circuit_breaker", "cooldowns", "page_completeness", "stage_timeline", "rolling_rate"):
            _beside(spark, tmp_path / name, {"events": events}, streams, f"stream_{name}")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_that_share_a_bucket_keep_their_own_timers(spark, monkeypatch):
    monkeypatch.setattr(timed, "BUCKETS", 2)
    con = connect(SF)
    for name in ("stream_submissions", "stream_interruptions"):
        assert_same(streams.QUERIES[name](spark, SF).toPandas(), con.execute(streams.SQL[name]).df())


def test_a_walk_that_stops_early_takes_the_first_of_the_whole_walk(spark):
    rng = random.Random(5)
    rows = [(i, rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(400)]  # all crowded: each shuts out a good part
    taken = []
    for i, x, y in rows:
        if all(math.dist((x, y), (rows[j][1], rows[j][2])) >= 20 for j in taken):
            taken.append(i)
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = sorted(r.id for r in accuracy.spaced(df, "id", F.col("id"), 20.0, 3).collect())
    assert len(got) >= 3 and got == taken[: len(got)]
