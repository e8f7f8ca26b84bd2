"""Frames as a source and sink, live processors, like words by keys, sweeps: against plain forms; failing tasks, restarts, late rows, ties."""

import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.similarity import ratio, token_set_ratio
from tidewell.operators import alike, detect, islands
from tidewell.sources import frames, wav
from tidewell.streaming import live
from tidewell.streaming.capture import Capture

FRAME = "channel long, at timestamp, text string, data binary"


def rows_of(spark, rows):
    return spark.createDataFrame([(c, t, x, y) for c, t, x, y in rows], "channel long, us long, text string, data binary").select("channel", F.timestamp_micros("us").alias("at"), "text", "data")


def read(df):
    return sorted((r.channel, r.us, r.text, None if r.data is None else bytes(r.data)) for r in df.select("channel", F.unix_micros("at").alias("us"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("data", F.unhex(F.lit(""))).alias("data")).collect())


def test_frames_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/f"
    rows = [(i % 3, 1_700_000_000_000_000 + i, f"é {i}" if i % 2 else "", None) for i in range(50)] + [(9, 1_700_000_000_000_500, None, bytes(range(7))), (9, 1_700_000_000_000_500, None, b""), (9, -5, "x" * 100_000, b"not this")]
    frames.append(rows_of(spark, rows).repartition(3), folder)
    frames.append(rows_of(spark, rows).limit(0), folder)
    frames.append(rows_of(spark, rows[:2]), folder)
    want = sorted((c, t, x or "", (y or b"") if x is None else b"") for c, t, x, y in [*rows, *rows[:2]])
    assert read(spark.read.format("frames").load(folder)) == want
    assert len(os.listdir(tmp_path / "f/_commits")) == 3
    assert spark.read.format("frames").load(f"file://{tmp_path}/nothing").count() == 0


def test_a_failing_task_leaves_no_frames(spark, tmp_path):
    folder = f"file://{tmp_path}/f"
    good = [(1, i, "x", None) for i in range(20)]
    for bad in (1, 5, None, None), (None, 5, "x", None):
        with pytest.raises(Exception, match="frame"):
            frames.append(rows_of(spark, [*good, bad]).repartition(4), folder)
        assert [x for x in os.listdir(tmp_path / "f") if x != "_commits"] == []
    frames.append(rows_of(spark, good).coalesce(1), folder)
    (path,) = (tmp_path / "f").glob("*/*.frames")
    with open(path, "ab") as f:
        f.write(struct.pack("<cqqI", b"T", 1, 1, 100) + b"cut")
    with pytest.raises(Exception, match="damaged at frame 20"):
        spark.read.format("frames").load(folder).count()


def test_frame_stream_restarts_behind_its_last_commit(spark, tmp_path):
    folder, seen = f"file://{tmp_path}/f", []
    for n in range(4):
        frames.append(rows_of(spark, [(n, i, json.dumps({"event": "e", "n": i}) if i % 4 else "{", None) for i in range(10)]), folder)
        if n == 2:
            continue  # two commits in one go
        good, _ = frames.events_of(frames.stream(spark, folder), "event STRING, n INT")
        judged = frames.judged(frames.stream(spark, folder), "event STRING, n INT").select("channel", "bad", "value")
        for name, df in (("good", good.select("channel", "value")), ("all", judged)):
            df.writeStream.option("checkpointLocation", f"file://{tmp_path}/state-{name}").trigger(availableNow=True).format("parquet").start(f"file://{tmp_path}/{name}").awaitTermination()
        seen.append((spark.read.parquet(f"file://{tmp_path}/good").count(), spark.read.parquet(f"file://{tmp_path}/all").where("bad").count()))
    assert seen == [(7, 3), (14, 6), (28, 12)]
    got = spark.read.parquet(f"file://{tmp_path}/good").groupBy("channel").agg(F.sum("value.n").alias("s")).collect()
    assert {r.channel: r.s for r in got} == dict.fromkeys(range(4), 45 - 12)


def test_frame_sink_of_a_stream(spark, tmp_path):
    first, second = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    for n in range(3):
        frames.append(rows_of(spark, [(n, i, f"{n}", None) for i in range(5)]), first)
        frames.stream(spark, first).writeStream.format("frames").option("checkpointLocation", f"file://{tmp_path}/s").trigger(availableNow=True).start(second).awaitTermination()
    assert read(spark.read.format("frames").load(second)) == read(spark.read.format("frames").load(first))
    writer = frames._StreamWrite(second)  # a micro-batch that is written again adds nothing
    there = lambda: len(list((tmp_path / "b").glob("*/*.frames")))
    before = there()
    import pyarrow as pa

    again = writer.write(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1], pa.timestamp("us", "UTC")), pa.array([0]), pa.array(["x"]), pa.array([None], pa.binary())], schema=frames.ARROW)]))
    writer.commit([again], 0)
    assert there() == before


def test_samples(spark):
    values = [0, 1, -1, 32767, -32768, 258, -25000]
    df = spark.createDataFrame([(bytes(np.array(values, "<i2").tobytes()) + b"\x01",), (b"",), (None,)], "data binary")
    got = [r.pcm for r in frames.samples_of(df).collect()]
    assert got == [values, [], None]
    back = spark.range(1).select(frames.pcm_bytes([F.lit(v) for v in values]).alias("b")).first().b
    assert bytes(back) == np.array(values, "<i2").tobytes()


def test_a_failing_job_leaves_no_wavs(spark, tmp_path):
    rows = [(f"a{i}.wav", b"RIFF%d" % i) for i in range(8)]
    df = lambda more: spark.createDataFrame([*rows, *more], "name string, wav binary").repartition(5)
    for bad in ("x.wav", None), ("sub/x.wav", b"1"), (None, b"1"):
        with pytest.raises(Exception, match="plain name"):
            wav.write_wavs(df([bad]), f"file://{tmp_path}/w")
        assert list((tmp_path / "w").rglob("*.*")) == []
    assert {r.name: r.bytes for r in wav.write_wavs(df([]), f"file://{tmp_path}/w").collect()} == {n: len(b) for n, b in rows}
    assert wav.write_wavs(df([]).limit(0), f"file://{tmp_path}/w").count() == 0


SCHEMA = "session long, what string, first_at long, end_at long, n long, transcript string"


def plain_utterances(rows, hold):
    """One channel's rows (at, event, body) in order; what is due by `until` at the end."""
    out, n, first, parts = [], 0, None, []
    for at, event, body in rows:
        if first is not None and at > first + hold:
            out.append((n, "orphan", first, first + hold, len(parts), " ".join(parts)))
            first = None
        if event == "wake":
            n, first, parts = n + 1, at, []
        elif first is not None and event == "drop":
            first = None
        elif first is not None and event == "end":
            out.append((n, "transcript", first, at, len(parts), " ".join(parts)))
            first = None
        elif first is not None and event == "segment" and body:
            parts.append(body)
    return out, (n, "orphan", first, first + hold, len(parts), " ".join(parts)) if first is not None else None


def test_utterances_with_late_rows_and_timers(spark):
    """Rows of one channel that are older than what it has seen are left out; ties go by place; an orphan needs no row of its own channel."""
    hold, r, rows, at = 1_000_000, random.Random(4), [], 1_700_000_000_000_000
    for i in range(500):
        at += r.choice([0, 1000, 90_000, 300_000])
        rows.append((r.randrange(3), at, i, r.choice(["wake", "segment", "segment", "end", "drop", ""]), r.choice(["a", "", "b c"])))
    rows.append((8, rows[-1][1] + 10, 900, "wake", ""))
    rows.append((9, rows[-1][1] + 5 * hold, 999, "segment", "its wake is missing"))
    late = (0, rows[0][1] - 50, 7, "wake", "late")  # comes in the last commit
    message = lambda x: (x[0], x[1], json.dumps({"id": x[2], "event": x[3], "body": x[4]}), None)

    def build(f):
        good, _ = frames.events_of(f, "id LONG, event STRING, body STRING")
        return live.run(good.select("channel", "at", F.col("value.id").alias("place"), "value.event", "value.body"), live.Utterances(hold), SCHEMA)

    got = live.replay(rows_of(spark, [message(x) for x in [*rows, late]]), 3, build)
    want = []
    for c in {x[0] for x in rows}:
        done, open_ = plain_utterances([x[1:2] + x[3:] for x in sorted([*rows, late] if c == 0 else rows, key=lambda x: (x[1], x[2])) if x[0] == c], hold)
        want += [(c, *x) for x in done] + ([(c, *open_)] if open_ and open_[3] < rows[-1][1] else [])
    assert any(x[2] == "orphan" and x[0] == 8 for x in want) and len(want) > 20
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_capture_gives_up():
    c = Capture(onset=10, drop=3, quiet=2, pre=2, tail=1, most=6, wait=3)
    assert [x for x in map(c.step, [0, 0, 0, 0, 20, 0, 0, 0, 0, 0, 0, 0, 20, 20, 20, 20, 20, 20]) if x] == [(0, 2, None), (3, 5, False), (7, 9, None), (10, 15, True)]


WORDS = ["delphin", "delfin", "dolphin", "gullwing", "gull", "wing", "observatory", "orbiter", "orbit", "a", "ab", "ba", "abc", "", None, "mississippi", "misisipi", "aaaaaa", "aaaa", "zzz", "é", "épée", "epee", "x y", "it's"]


@pytest.mark.parametrize(("least", "size", "shortest"), [(75, 5, 5), (70, 4, 0), (65, 3, 0), (90, 99, 0)])
def test_alike_equals_nested_loops(spark, least, size, shortest):
    r = random.Random(least)
    a = [*WORDS, *("".join(r.choices("abcdeio", k=r.randrange(1, 9))) for _ in range(120))]
    b = [*WORDS, *("".join(r.choices("abcdeio", k=r.randrange(1, 9))) for _ in range(120))]
    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    got = {tuple(x) for x in alike.alike(left, right, float(least), size, shortest).collect()}
    fits = lambda x, y: (ratio(x, y) >= least and min(len(x), len(y)) >= shortest) or (min(len(x), len(y)) >= size and (x in y or y in x))
    assert got == {(x, y) for x in filter(None, a) for y in filter(None, b) if fits(x, y)} and len(got) > 20
    plan = alike.alike(left, right, float(least), size, shortest)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Join Inner\n" not in plan


def test_token_sets_equal_nested_loops(spark):
    r = random.Random(8)
    some = ["river", "sounding", "mission", "delphin", "two", "the", "ice", "mapper", "probe", "a", "misson", "rivers"]
    texts = [" ".join(r.choices(some, k=r.randrange(0, 4))) for _ in range(150)]
    left, right = spark.createDataFrame([(x,) for x in texts[:75]], "a string"), spark.createDataFrame([(x,) for x in texts[75:]], "b string")
    got = {(x.a, x.b): x.s for x in alike.sets_near(left, right, 65.0).collect()}
    assert got == {(x, y): token_set_ratio(x, y) for x in texts[:75] for y in texts[75:] if token_set_ratio(x, y) >= 65} and got


def test_score_equals_nested_loops(spark):
    r = random.Random(2)
    fires = sorted({(t, s, r.randrange(60)) for t in (0.1, 0.2) for s in range(4) for _ in range(9)})
    spans = [(r.randrange(5), a := r.randrange(60), a + r.choice([0, 1, 3, 20])) for _ in range(40)]
    spans += spans[:3]  # repeated intervals count each; empty ones hold nothing
    hours = spark.createDataFrame([(0.1, 2.0), (0.2, 4.0), (0.3, 1.0)], "theta double, hours double")
    got = detect.score(spark.createDataFrame(fires, "theta double, stream_id long, hop int"), spark.createDataFrame(spans, "stream_id long, start_hop int, end_hop int"), hours, ("theta",)).collect()
    for x in got:
        own = [(s, h) for t, s, h in fires if t == x.theta]
        false = sum(not any(s == v and a <= h < e for v, a, e in spans) for s, h in own)
        missed = sum(not any(s == v and a <= h < e for s, h in own) for v, a, e in spans)
        assert (x.n_fires, x.n_false, x.n_missed, x.n_keywords) == (len(own), false, missed, len(spans))
    assert len(got) == 3


def test_sweeps_have_no_range_join(spark):
    fires = spark.createDataFrame([(1, 3)], "stream_id long, hop int")
    spans = spark.createDataFrame([(1, 2, 5)], "stream_id long, start_hop int, end_hop int")
    plans = [detect.score(fires, spans, spark.createDataFrame([(1.0,)], "hours double")), islands.dominant(spark.createDataFrame([(1, 0, 1.0), (1, 1, 50.0)], "stream_id long, hop int, db double"))]
    for p in plans:
        text = p._jdf.queryExecution().optimizedPlan().toString()
        assert ">= start_hop" not in text and "Join Inner, ((" not in text
    assert plans[0].first().n_false == 0


# long streams, places


@pytest.mark.parametrize(("piece", "hops"), [(16, 10), (16, 16), (64, 1), (1 << 16, 10)])
def test_long_streams_fire_as_short_ones(spark, piece, hops):
    from tidewell.operators import long

    r = np.random.default_rng(piece + hops)
    rows = [(s, h, float(v)) for s, n in ((1, 700), (2, 3), (3, 130), (None, 90)) for h, v in enumerate(r.random(n))]
    rows += [(4, h, float(200 < h < 230 or h == 390)) for h in range(400)]  # pieces without candidates in between
    df = spark.createDataFrame(rows, "stream_id long, hop int, prob double")
    got = sorted((str(x.stream_id), x.hop) for x in long.detect(df, 0.4, 2, 4, hops, piece=piece).collect())
    want = sorted((str(x.stream_id), x.hop) for x in detect.detect(df, 0.4, 2, 4, hops).collect())
    assert got == want and len(got) > 30
    assert long.detect(df.limit(0), 0.4, 2, 4, hops, piece=piece).count() == 0


def test_exits_follow_every_entry():
    from tidewell.operators import long

    r = random.Random(1)
    for _ in range(300):
        at = np.array(sorted(r.sample(range(20), r.randrange(0, 15))), np.int64)
        hops, want = r.randrange(1, 9), []
        for blocked in range(hops + 1):
            last = None
            for a in at.tolist():
                if a >= blocked and (last is None or a - last >= hops):
                    last = a
            want.append(max(0, last + hops - 20) if last is not None else 0)
        assert long.exits(at, hops, 20) == want


def test_places_and_percentiles(spark):
    from tidewell.operators import ranks

    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.choice([1.0, 2.5, 7.0, r.random(), None])) for _ in range(700)] + [("c", 3.0)] + [("d", None)] + [("e", 5.0)] * 300
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {x.g: x for x in ranks.percentiles(df, "v", ["g"], [0, 10, 50, 99, 100]).collect()}
    for g in {x[0] for x in rows} - {"d"}:
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g].n == len(own)
        for p in 0, 10, 50, 99, 100:
            assert abs(got[g][f"p{p}"] - np.percentile(own, p)) < 1e-12
    assert "d" not in got
    (one,) = ranks.percentiles(df, "v", [], [50]).collect()
    assert abs(one.p50 - np.percentile([v for _, v in rows if v is not None], 50)) < 1e-12
    places = ranks.placed(spark.range(1000).repartition(5).withColumn("k", (F.col("id") * 7919) % 1000), ["k"]).collect()
    assert sorted((x.k, x.place) for x in places) == [(i, i) for i in range(1000)]
