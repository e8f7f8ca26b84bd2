"""What the third review found: hops without power, exact digits, live queries and grids that grow with their input."""

import datetime
import random

import pandas as pd
import pytest
from oracle import duck, same
from pyspark.sql import functions as F

from tidewell.functions import signal
from tidewell.plans import catalogue
from tidewell.streaming import live, shards

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, folder, streams, step=1):
    """An event table whose streams hold these values, one every `step` minutes."""
    rows = [(u * 1000 + i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i * step), u, ("view", "click", "signup", "purchase", "error")[(u + 3 * i) % 5], v, f'{{"k": {i % 7}}}') for u, values in streams.items() for i, v in enumerate(values)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    return str(folder)


def agrees(spark, folder, name):
    got = catalogue.QUERIES[name](spark, folder).toPandas()
    same(got, duck(folder).sql(catalogue.SQL[name]).df())
    return got


# F1


@pytest.mark.parametrize("silent", [1, 2, 5, 20])
def test_dominant_run_counts_hops_without_power(spark, tmp_path, silent):
    """A hop of value 0 is one of -inf dB: it belongs to the floor's percentile."""
    rise = [10.0 ** (i / 20) for i in range(41)]
    assert len(agrees(spark, events(spark, tmp_path, {1: rise + [0.0] * silent, 2: rise, 3: [0.0] * 9, 4: [5.0]}), "dominant_run")) >= 2


# F2


EXACT = [0.1494140625, -0.1494140625, 0.0625, 1.0000000050000001, 2.5, 0.0, -0.0, 1e300, -3e-7, 5e-324, 1.005, float("inf"), float("-inf"), float("nan")]


def test_numbers_are_printed_from_their_exact_values(spark):
    df = spark.createDataFrame([(1, EXACT), (2, []), (3, None), (4, [None, 0.1494140625])], "id int, x array<double>")
    for form in "%.8e", "%.3f":
        got = {r.id: r.s for r in df.select("id", signal.printed(F.col("x"), form).alias("s")).collect()}
        assert got == {1: [form % x for x in EXACT], 2: [], 3: None, 4: [None, form % 0.1494140625]}


def test_digests_of_numbers_that_end_in_half_a_digit(spark, tmp_path):
    rows = [(1, [0.1494140625, 1.5]), (2, [0.5 + 2.0**-n for n in range(1, 20)]), (3, []), (4, None), (5, [0.25, None])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert len(agrees(spark, str(tmp_path), "matrix_dump")) == 5


def test_preroll_of_numbers_that_end_in_half_a_digit(spark, tmp_path):
    assert len(agrees(spark, events(spark, tmp_path, {1: [200.0625, 0.1875, 151.3125, 160.0005]}), "preroll")) == 3


# F3, F4, F5


class State:
    """A shard's state as Spark hands it over; counts what it is asked."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.mark, self.updates, self.timeout = None, False, False, 0, 0, None

    def getCurrentWatermarkMs(self):
        return self.mark

    def update(self, value):
        self.get, self.exists, self.updates = value, True, self.updates + 1

    def setTimeoutTimestamp(self, ms):
        assert ms >= self.mark
        self.timeout = ms


def taken(processor, state, rows, timed_out=False):
    state.hasTimedOut, state.timeout = timed_out, None
    pdf = pd.DataFrame(rows, columns=["channel", "at", "place", "event", "body"])
    return [tuple(x) for df in processor.take((3,), iter([pdf]), state) for x in df.itertuples(index=False)]


def test_a_shard_asks_for_its_state_once():
    state, p = State(), live.Utterances(5_000)
    got = taken(p, state, [(c, 1_000_000 + c, i, what, "x") for c in range(500) for i, what in enumerate(["wake", "segment"])])
    assert got == [] and state.updates == 1 and state.timeout == 1005  # first due at 1 005 001 us, so at 1006 ms: when the mark is behind 1005
    state.mark = 1006  # a row of one channel; what is due in the others by then is done too
    got = taken(p, state, [(7, 1_006_500, 2, "end", "")])
    assert got == [(7, 1, "orphan", 1_000_007, 1_005_007, 1, "x")] + [(c, 1, "orphan", 1_000_000 + c, 1_005_000 + c, 1, "x") for c in range(500) if c != 7]
    assert state.updates == 2 and state.timeout is None


def test_a_shard_wakes_at_its_first_timer():
    state, p = State(), live.Shown({"content": 10_000})
    taken(p, state, [(1, 5_000, 0, "content", None), (2, 2_000, 0, "content", None), (3, 1_000, 0, "wake", None)])
    assert state.timeout == 11
    state.mark = 12
    assert taken(p, state, [], timed_out=True) == [(2, 12_000, "idle")] and state.timeout == 14
    state.mark = 15
    assert taken(p, state, [], timed_out=True) == [(1, 15_000, "idle")] and state.timeout is None


@pytest.mark.parametrize("name", ["live_utterances", "live_states", "live_buffer"])
def test_live_queries_with_channels_in_shared_groups(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(shards, "SHARDS", 2)
    r = random.Random(5)
    agrees(spark, events(spark, tmp_path, {u: [round(r.random() * 200, 2) for _ in range(r.randrange(1, 60))] for u in range(9)}, step=157), name)


# F6, F7, F9


@pytest.mark.parametrize("name", ["utterance_capture_live", "utterance_fsm_live", "capture_attempts_live"])
def test_live_machines_with_streams_of_any_length(spark, tmp_path, monkeypatch, name):
    """A long stream goes over all micro-batches; each is written by tasks, not pulled into one."""
    monkeypatch.setattr(shards, "SHARDS", 2)
    seen = []
    monkeypatch.setattr(live, "remove", lambda spark, path: seen.append(path))
    r = random.Random(6)
    agrees(spark, events(spark, tmp_path, {1: [round(r.random() * 120, 2) for _ in range(400)], 2: [90.0], 3: [0.0] * 30, 4: [round(r.random() * 200, 2) for _ in range(90)]}), name)
    base = next(x for x in seen if x.endswith("/in"))
    n = spark.read.parquet(base).withColumn("f", F.input_file_name()).groupBy("f").agg(F.count("*").alias("n"), F.max("hop").alias("top")).collect()
    assert sum(x.n for x in n) == 521 and max(x.n for x in n) < 260


# F8


def test_grid_is_counted_in_one_pass(spark, tmp_path):
    r = random.Random(7)
    values = [round(r.random() * 60, 1) for _ in range(300)]
    folder = events(spark, tmp_path, {1: values, 2: [10.0, None, 55.0, None, 55.0, 50.0, 25.0], 3: [1.0], 4: values[::-1]})
    assert len(agrees(spark, folder, "param_grid_best")) == 1
    assert "Join" not in catalogue.QUERIES["param_grid_best"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert len(agrees(spark, events(spark, tmp_path, {1: [3.0, 20.0]}), "param_grid_best")) == 0
    assert len(agrees(spark, events(spark, tmp_path, {1: [3.0, 21.0]}), "param_grid_best")) == 1
