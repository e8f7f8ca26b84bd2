"""Sources and sinks: round trips through files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import scorer
from tidewell.sources import files, generate, wav
from tidewell.streaming import detector


def some(n=5):
    r = np.random.default_rng(3)
    return {f"take{i}.wav": r.integers(-32768, 32768, 200 + i, dtype=np.int16) for i in range(n)}


def test_wav_files(spark, tmp_path):
    clips = some()
    df = spark.createDataFrame([(k, bytearray(wav.wav_bytes(v))) for k, v in clips.items()], "name string, wav binary")
    folder = f"file://{tmp_path}/wavs"
    written = {r.name: r.bytes for r in wav.write_wavs(df, folder).collect()}
    assert written == {k: 44 + 2 * len(v) for k, v in clips.items()}
    wav.write_wavs(df.limit(2), folder)  # again: the others stay
    (tmp_path / "wavs/.hidden.wav").write_bytes(b"x")
    (tmp_path / "wavs/note.txt").write_text("x")
    rows = wav.read_wavs(spark, folder).collect()
    assert [r.name for r in rows] == sorted(clips)
    for r in rows:
        assert np.array_equal(np.array(r.samples) * 32768, clips[r.name])
    assert wav.read_wavs(spark, f"file://{tmp_path}/nowhere").count() == 0
    sums = {r.name: (r.sha256, r.length) for r in wav.digests(spark, folder).collect()}
    import hashlib

    for k, v in clips.items():
        assert sums[k] == (hashlib.sha256(wav.wav_bytes(v)).hexdigest(), 44 + 2 * len(v))


def test_bad_wavs():
    good = wav.wav_bytes(np.zeros(10, np.int16))
    assert len(wav.wav_samples(good)) == 10
    for bad in (b"", good[:8] + b"XXXX" + good[12:], wav.wav_bytes(np.zeros(4, np.int16), 8000), good[:20]):
        with pytest.raises(ValueError):
            wav.wav_samples(bad)


def test_manifest(spark, tmp_path):
    for name in ("pos/a.wav", "pos/.b.wav", "neg/c.wav", "gsc/yes/d.wav", "gsc/no/e.wav", "gsc/_noise_/f.wav"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(wav.wav_bytes(np.zeros(3, np.int16)))
    base = f"file://{tmp_path}"
    got = wav.read_manifest(spark, [(f"{base}/pos", 2, "positives"), (f"{base}/neg", 1, "hard_neg"), (f"{base}/legacy", 2, "legacy")], [(f"{base}/gsc", 1, "gsc"), (f"{base}/none", 1, "none")])
    rows = sorted((r.path.split("/")[-1], r.label_index, r.source, r.word) for r in got.collect())
    assert rows == [("a.wav", 2, "positives", None), ("c.wav", 1, "hard_neg", None), ("d.wav", 1, "gsc", "yes"), ("e.wav", 1, "gsc", "no")]


def test_last_row_of_a_file_wins(spark, tmp_path):
    """Redone takes are appended in part files with random names; also where no time was recorded."""
    cols = [c.split()[0] for c in wav.MANIFEST.split(", ")]
    path = f"file://{tmp_path}/manifest"

    def rows(*takes):
        data = [dict.fromkeys(cols) | {"file": f, "n": n, "recorded_at": t} for f, n, t in takes]
        wav.append_csv(spark.createDataFrame([tuple(d[c] for c in cols) for d in data], wav.MANIFEST.replace("recorded_at TIMESTAMP_NTZ", "recorded_at STRING")).select(*[F.col("recorded_at").cast("timestamp_ntz") if c == "recorded_at" else c for c in cols]).coalesce(1), path)

    import time

    for i in range(6):
        rows(("a", i, f"2024-01-01 00:00:0{i}"), ("b", i, None), *([("c", 9, None)] if not i else []))
        time.sleep(0.02)
    got = {r.file: r.n for r in wav.read_capture_manifest(spark, path).collect()}
    assert got == {"a": 5, "b": 5, "c": 9}


def test_matrix_and_metrics(spark, tmp_path):
    m = [[1.5, -2.25, 3e-7], [0.0, 5.0, 6.125]]
    df = spark.createDataFrame([(1, m)], "id int, m array<array<double>>")
    lines = [r.line for r in wav.matrix_lines(df, "id", "m").orderBy("row").collect()]
    assert lines == [",".join(f"{x:.8e}" for x in row) for row in m]
    (tmp_path / "m.csv").write_text("\n".join(lines))
    (tmp_path / "flat.txt").write_text(" ".join(str(x) for row in m for x in row))
    for name in ("m.csv", "flat.txt"):
        assert wav.read_matrix(spark, f"file://{tmp_path}/{name}", 3).first().m == m
    (tmp_path / "bad.txt").write_text("1 2 3 4")
    with pytest.raises(Exception, match="another width"):
        wav.read_matrix(spark, f"file://{tmp_path}/bad.txt", 3).collect()
    wav.write_metrics(spark.createDataFrame([(1, 0.5)], "n int, tpr double"), f"file://{tmp_path}/metrics")
    assert spark.read.json(f"file://{tmp_path}/metrics").collect()[0].asDict() == {"n": 1, "tpr": 0.5}


def test_json_rows_and_faults(spark, tmp_path):
    (tmp_path / "kb.json").write_text(json.dumps([{"id": "a", "aliases": ["x", "y"]}, {"id": "b"}], indent=1))
    got = files.read_json_rows(spark, f"file://{tmp_path}/kb.json", "id STRING, aliases ARRAY<STRING>").orderBy("id").collect()
    assert [(r.id, r.aliases) for r in got] == [("a", ["x", "y"]), ("b", None)]
    raw = ['{"event": "wake", "t1": 1.5}', "{broken", "", None, '{"event": "level"}', "[1]"]
    good, bad = files.decoded(spark.createDataFrame(list(enumerate(raw)), "i int, raw string"), "raw", "event STRING, t1 DOUBLE")
    assert [(r.i, r.value.event, r.value.t1) for r in good.orderBy("i").collect()] == [(0, "wake", 1.5), (4, "level", None)]
    assert sorted(r.i for r in bad.collect()) == [1, 2, 3, 5]


def test_listing_and_single(spark, tmp_path):
    for n in ("s1_a.wav", "s2_b.wav", "s2_c.wav"):
        (tmp_path / n).write_bytes(b"1234")
    there = files.listing(spark, f"file://{tmp_path}")
    assert sorted((r.name, r.length) for r in there.collect()) == [("s1_a.wav", 4), ("s2_b.wav", 4), ("s2_c.wav", 4)]
    assert files.single(there, "^s1_").first().name == "s1_a.wav"
    for pattern, what in (("^s2_", "2 files fit"), ("^s3_", "no file fits")):
        with pytest.raises(Exception, match=what):
            files.single(there, pattern).collect()
    need = spark.createDataFrame([("s1_a.wav",), ("s9.wav",)], "name string")
    assert [r.name for r in files.missing(need, there, "name").collect()] == ["s9.wav"]
    assert {r.name: r.missing for r in files.report(need, there, "name").collect()} == {"s1_a.wav": False, "s9.wav": True}


def test_noise(spark):
    x = {r.kind: np.array(r.samples, float) for r in generate.signals(spark, 16384).collect()}
    white = x["white"] / 32768
    assert abs(white.mean()) < 0.02 and white.std() > 0
    pink = np.array(spark.createDataFrame([(white.tolist(),)], "w array<double>").select(generate.pink(F.col("w")).alias("p")).first().p)
    low, high = (np.abs(np.fft.rfft(pink - pink.mean()))[a:b].mean() for a, b in ((4, 64), (2048, 8000)))
    assert len(pink) == len(white) and low > 3 * high  # its spectrum falls


def test_fan_out_drops_a_failing_sink(spark, tmp_path):
    spark.range(20).repartition(4).write.parquet(f"file://{tmp_path}/in")
    live = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    seen, failed = [], []

    def bad(df, n):
        failed.append(n)
        raise RuntimeError("gone")

    wav.fan_out(live, [lambda df, n: seen.append(df.count()), bad], f"file://{tmp_path}/state").awaitTermination()
    assert sum(seen) == 20 and len(seen) > 1 and len(failed) == 1


def test_detector_carries_state(spark, tmp_path):
    """The streaming detector over many micro-batches equals the batch one."""
    from conftest import SMALL

    from tidewell.operators import detect

    e = spark.read.parquet(f"{SMALL}/events.parquet")
    for i, (a, b) in enumerate(((0, 150), (150, 151), (151, 600), (600, 10_000))):
        e.where(f"event_id >= {a} AND event_id < {b}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/p{i}")
    order = e.orderBy("ts", "event_id").select("event_id").toPandas()["event_id"].tolist()
    assert order == sorted(order)  # event ids follow time here
    live = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    got = {(r.stream_id, r.hop) for r in detector.run_to_table(detector.fires(live, 50.0, 3, 5, 10)).collect()}
    want = {(r.stream_id, r.hop) for r in detect.detect(detect.events_as_stream(e), 50.0, 3, 5, 10).collect()}
    assert got == want and want


def test_windowed_levels_drop_late_rows(spark, tmp_path):
    row = lambda i, t, v: (i, t, 1, "view", v)
    batches = [[row(1, "2024-01-01 00:05:00", 3.0), row(2, "2024-01-01 00:07:00", 4.0)], [row(3, "2024-01-01 06:00:00", 1.0)], [row(6, "2024-01-01 06:30:00", 1.0)], [row(4, "2024-01-01 00:06:00", 100.0)], [row(5, "2024-01-01 12:00:00", 1.0)]]
    schema = "event_id long, ts string, user_id long, event_type string, value double"
    import time

    for b in batches:
        spark.createDataFrame(b, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1.1)
    live = spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = detector.run_to_table(detector.windowed_levels(live, size="1 hour", slide="1 hour"))
    first = [r for r in got.collect() if str(r.window.start) == "2024-01-01 00:00:00"]
    assert len(first) == 1 and first[0].n == 2 and abs(first[0].rms - np.sqrt(12.5)) < 1e-9


def test_scorer_with_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 3.0])], "i int, features array<double>")
    got = {r.i: r for r in scorer.scored_int8(scorer.scored(df, lambda x: x), lambda q: q.astype(int), (1.0, 0), (1.0, 0)).collect()}
    assert got[2].probs is None and got[2].q is None and got[2].probs_int8 is None
    for i in (1, 3):
        assert np.allclose(got[i].probs, got[i].probs_int8) and abs(sum(got[i].probs) - 1) < 1e-12
    assert got[3].q == [0, 3]
    assert scorer.scored(df.limit(0), lambda x: x).count() == 0


def test_detector_leaves_out_late_rows():
    """A row older than one taken before moves no hop; ties at the last time are taken."""
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, values):
            self.exists, self.get = True, values

    step, state = detector.detector(0.5, 1, 1, 1), State()

    def hops(*rows):
        df = pd.DataFrame({"ts": pd.to_datetime([f"2024-01-01 00:00:{s:02d}.000001" for s, _, _ in rows]), "event_id": [i for _, i, _ in rows], "value": [v for _, _, v in rows]})
        return [h for out in step((7,), [df], state) for h in out["hop"]]

    assert hops((10, 1, 0.9), (12, 2, 0.1)) == [0]
    assert hops((11, 3, 0.9), (12, 4, 0.9), (13, 5, 0.9)) == [2, 3]
    assert hops((1, 6, 0.9)) == [] and hops((14, 7, 0.9)) == [4]
