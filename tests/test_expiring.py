"""Expiring counters, breakers and watched files: batch against brute force, streams against batch."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import expiring
from vellum.operators.events import audit
from vellum.streaming import state, stateful

SF = "/root/testdata/sf0.001"


def brute_counts(rows, seconds):
    out, held = [], {}
    for user, seq, us in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        start, n = held.get(user, (None, 0))
        if start is None or us >= start + seconds * 1_000_000:
            start, n = us, 0
        held[user] = (start, n + 1)
        out.append((user, seq, us, start, n + 1))
    return sorted(out)


def test_counts_begin_anew_when_their_time_is_over(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randrange(0, 60) * 1_000_000) for i in range(300)]
    rows += [(4, 1000, 0), (4, 1001, 9_999_999), (4, 1002, 10_000_000), (4, 1003, 10_000_000), (5, 1, 7)]
    df = spark.createDataFrame(rows, "user_id long, seq long, us long").withColumn("n", F.lit("own"))
    got = sorted(map(tuple, expiring.expiring_counts(df, 10).collect()))
    assert got == brute_counts(rows, 10)
    assert [r[4] for r in got if r[0] == 4] == [1, 2, 1, 2]
    assert expiring.expiring_counts(df.limit(0), 10).collect() == []


def brute_breaker(rows, run, seconds):
    out, held = [], {}
    for user, model, seq, us, ok in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2])):
        fails, since = held.get((user, model), (0, None))
        change = None
        if since is None:
            fails = 0 if ok else fails + 1
            if fails == run:
                change, since = "opened", us
        elif us >= since + seconds * 1_000_000:
            change, fails, since = ("recovered", 0, None) if ok else ("reopened", 0, us)
        held[(user, model)] = (fails, since)
        if change:
            out.append((user, model, seq, us, change))
    return out


def changes(opened):
    rows = opened.collect()
    out = [(r.user_id, r.model, r.seq, r.us, "reopened" if r.reopened else "opened") for r in rows]
    return sorted(out + [(r.user_id, r.model, r.probe_seq, r.probe_us, "recovered") for r in rows if r.recovered])


@pytest.mark.parametrize("run, seconds", [(3, 5), (2, 11), (1, 3)])
def test_breakers_open_probe_and_recover(spark, run, seconds):
    rng = random.Random(run)
    rows = [(rng.choice([1, 1, 2]), rng.choice("ab"), i, rng.randrange(0, 300) * 1_000_000, rng.random() < 0.4) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, model string, seq long, us long, ok boolean")
    assert changes(expiring.openings(df, run, seconds)) == sorted(brute_breaker(rows, run, seconds))
    assert expiring.openings(df.limit(0), run, seconds).collect() == []


def test_failover_goes_to_the_first_model_that_is_up(spark):
    s = 1_000_000
    rows = [(1, "a", 1, 10 * s, 20 * s, True), (1, "b", 2, 12 * s, None, None), (1, "c", 3, 15 * s, None, None), (1, "b", 4, 25 * s, None, None), (2, "a", 5, 15 * s, None, None)]
    df = spark.createDataFrame(rows, "user_id long, model string, seq long, us long, probe_us long, recovered boolean")
    got = {r.seq: r.to_model for r in expiring.failovers(df, ("a", "b", "c")).collect()}
    assert got == {1: "b", 2: "c", 3: "a", 4: "a", 5: "b"}  # 3: none is up, so the first of all


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def arriving(spark, tmp_path, files=3):
    """The events in files by time, and as a stream of one file a trigger."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k, (low, high) in enumerate(zip([0, 300, 700], [300, 700, 10**9])):
        events.where((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        del k
    return events, state.source(spark, f"{tmp_path}/in")


def run_stream(df, tmp_path, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streamed_counts_agree_with_the_batch(spark, store, tmp_path):
    events, stream = arriving(spark, tmp_path)
    got = run_stream(stateful.expiring_counts(audit(stream), 6 * 3600), tmp_path, "counts")
    want = expiring.expiring_counts(audit(events), 6 * 3600).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == events.count()


def test_streamed_breakers_agree_with_the_batch(spark, store, tmp_path):
    events, stream = arriving(spark, tmp_path)
    as_outcomes = lambda df: audit(df).select("user_id", F.col("event_type").alias("model"), "ts", "seq", "us", (F.col("value") >= 60).alias("ok"))
    got = run_stream(stateful.breakers(as_outcomes(stream)), tmp_path, "breakers")
    assert sorted(tuple(r) for r in got if r.change != "probing") == changes(expiring.openings(as_outcomes(events)))
    opened = {(r.user_id, r.model, r.us) for r in got if r.change in ("opened", "reopened")}
    due = {(r.user_id, r.model, r.us - expiring.COOL_SECONDS * 1_000_000) for r in got if r.change == "probing"}
    assert due and due <= opened


def test_watched_files_give_one_event_for_each_change(spark, store, tmp_path):
    for job in ("a", "b"):
        os.makedirs(f"{tmp_path}/w/jobs/{job}")
    def put(job, text, at):
        path = f"{tmp_path}/w/jobs/{job}/progress.json"
        with open(path, "w") as f:
            f.write(text)
        os.utime(path, (at, at))
    put("a", '{"n": 1}', 1000)
    put("b", '{"n": 1}', 1000)
    log, told = f"{tmp_path}/log", []
    for k, change in enumerate([None, ("a", '{"n": 2}', 2000), None, ("a", '{"n": 3}', 3000), ("a", '{"n": 9}', 2500)]):
        if change:
            put(*change)
        stateful.log_versions(spark, f"{tmp_path}/w", log)
        stateful.changed_progress(spark, log).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(stateful.VERSIONS).parquet(f"{tmp_path}/out").collect()
        told.append(sorted((r.path.split("/")[-2], r.json) for r in rows))
    first = [("a", '{"n": 1}'), ("b", '{"n": 1}')]
    assert told[0] == first and told[1] == told[2] == sorted([*first, ("a", '{"n": 2}')])
    assert told[3] == told[4] == sorted([*first, ("a", '{"n": 2}'), ("a", '{"n": 3}')])  # a late version is refused
