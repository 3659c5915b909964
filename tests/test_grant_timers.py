"""Grants as state with timers: decisions, revocations, ends by the watermark, and grants from before."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorespark.streaming import streams

START = datetime(2024, 1, 1)
SCHEMA = "request_id long, event string, ts timestamp, ttl_minutes long"


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_life_of_grants(spark, tmp_path):
    batches = [
        [(1, "approve", at(0), 30), (2, "approve", at(1), 500), (3, "deny", at(2), None), (4, "approve", at(3), None), (1, "deny", at(4), None)],
        [(3, "approve", at(40), 10), (2, "revoke", at(41), None), (5, "approve", at(42), 60), (6, "revoke", at(43), None)],
        [(9, "deny", at(300), None)],
        [(9, "deny", at(301), None)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.createDataFrame([(7, at(90)), (8, at(9000)), (10, None)], "request_id long, expires_at timestamp")
    stream = streams.events(spark, f"{tmp_path}/in", SCHEMA, 1)
    found = streams.run_now(spark, streams.timed_grants(stream, before), f"{tmp_path}/run")
    got = sorted((r.request_id, r.status, r.at, r.expires_at) for r in found.collect())
    assert [g[:3] for g in got] == [
        (1, "approved", at(0)), (1, "expired", at(30)), (2, "approved", at(1)), (2, "revoked", at(41)), (3, "denied", at(2)), (4, "approved", at(3)),
        (5, "approved", at(42)), (5, "expired", at(102)), (7, "expired", at(90)), (9, "denied", at(300)),
    ]
    assert {g[0]: g[3] for g in got if g[1] == "approved"} == {1: at(30), 2: at(501), 4: None, 5: at(102)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != streams.ROCKS


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    found = streams.run_now(spark, streams.timed_grants(streams.events(spark, f"{tmp_path}/in", SCHEMA)), f"{tmp_path}/run")
    assert found.select(F.count("*")).first()[0] == 0
