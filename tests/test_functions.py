"""Functions against plain Python forms of their rules."""

import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell import params
from tidewell.functions import mfcc, signal
from tidewell.functions import text as T
from tidewell.functions.similarity import lcs, metaphone, ratio, token_set_ratio
from tidewell.operators import detect, sessions
from tidewell.operators.match import Matcher
from tidewell.sources import wav
from tidewell.streaming.capture import Capture


@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_lcs(a, b):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
    assert lcs(a, b) == row[-1][-1]


def test_similarities():
    assert ratio("harbor", "harbour") == pytest.approx(1200 / 13)
    assert ratio("", "") == 100 and ratio("a", "") == 0
    assert token_set_ratio("green valley", "valley green farm") == 100
    assert token_set_ratio("", "a") == 0
    assert [metaphone(w) for w in ("knight", "moon", "mean", "school", "physics", "which", "")] == ["NT", "MN", "MN", "SKL", "FSKS", "WX", ""]


def test_mfcc_of_silence_and_shape():
    m = mfcc.mfcc_of(np.zeros((1, 16000), np.int16))
    assert m.shape == (1, 49, 10)
    assert m[0, :, 0] == pytest.approx(np.full(49, np.log(1e-6) * np.sqrt(40)), rel=1e-5)
    assert abs(m[0, :, 1:]).max() < 1e-3


def plain_mfcc(pcm):
    """The definition step by step: pre-emphasis, Hann frames, a plain DFT, mel triangles, log, DCT-II."""
    x = np.asarray(pcm, float) / 32768
    x = np.concatenate([x[:1], x[1:] - 0.97 * x[:-1]])
    n = np.arange(640)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * n / 639)
    k = np.arange(513)
    turn = np.exp(-2j * np.pi * np.outer(n, k) / 1024)
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [int(np.floor(1025 * to_hz(m) / 16000)) for m in np.linspace(to_mel(20), to_mel(4000), 42)]
    out = []
    for f in range(49):
        power = np.abs((x[320 * f : 320 * f + 640] * hann) @ turn) ** 2
        logs = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:], strict=False):
            up = sum(power[i] * (i - lo) / (mid - lo) for i in range(lo, mid))
            down = sum(power[i] * (hi - i) / (hi - mid) for i in range(mid, hi))
            logs.append(np.log(up + down + 1e-6))
        out.append([sum(v * np.cos(np.pi / 40 * (j + 0.5) * c) for j, v in enumerate(logs)) * np.sqrt((1 if c == 0 else 2) / 40) for c in range(10)])
    return np.array(out)


def test_mfcc_against_the_definition():
    t = np.arange(16000)
    clips = [8000 * np.sin(2 * np.pi * 440 * t / 16000), 8000 * np.sin(2 * np.pi * (100 * t / 16000 + 1950 * (t / 16000) ** 2)), np.where(t * 500 // 16000 % 2 == 0, 6000, -6000), np.random.default_rng(1).integers(-9000, 9000, 16000)]
    clips = np.stack([np.rint(c).astype(np.int16) for c in clips])
    got = mfcc.mfcc_of(clips)
    for i, c in enumerate(clips):
        assert np.abs(got[i] - plain_mfcc(c)).max() < 5e-3


def test_dct_is_orthonormal():
    _, dct, _ = mfcc.tables()
    assert np.abs(dct @ dct.T - np.eye(10)).max() < 1e-4


def test_resampled_keeps_a_tone():
    t = np.sin(2 * np.pi * 5 * np.arange(200) / 200)
    assert np.abs(mfcc.resampled(t, 100) - np.sin(2 * np.pi * 5 * np.arange(100) / 100)).max() < 1e-9


def test_signal_functions(spark):
    row = spark.sql("SELECT array(1.0D, -1.0D, 0.5D) AS x, array() AS e").select(
        signal.fit_to_clip(F.col("x"), 6).alias("padded"),
        signal.fit_to_clip(F.col("x"), 2).alias("cut"),
        signal.windows(F.col("x"), 2, 1).alias("w"),
        signal.to_pcm16(F.col("x")).alias("pcm"),
        signal.pre_emphasis(F.col("x"), 0.5).alias("pre"),
        signal.softmax(F.col("x")).alias("p"),
        signal.upto(F.lit(0)).alias("none"),
    ).first()
    assert row.padded == [0, 1.0, -1.0, 0.5, 0, 0] and row.cut == [1.0, -1.0]
    assert row.w == [[1.0, -1.0], [-1.0, 0.5]] and row.pcm == [32767, -32768, 16384] and row.none == []
    assert row.pre == [1.0, -1.5, 1.0] and sum(row.p) == pytest.approx(1)


TEXTS = ["Where is the b c d depot", "a b  c", "x", "", "bc d e f gh", "q r s t", "a1 b c", "I a b"]


def plain_collapse(text):
    """Token by token: a lower-case letter that follows another one is put against it."""
    out, before = "", None
    for word, space in re.findall(r"(\S+)(\s*)", text):
        single = re.fullmatch("[a-z]", word)
        if single and before:
            out = out.rstrip()
        before = single
        out += word + space
    return out


def test_acronyms_against_a_loop(spark):
    got = [r[0] for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").select(T.collapse_acronyms(F.col("t"))).collect()]
    assert got == [plain_collapse(t) for t in TEXTS]


def test_text_functions(spark):
    r = spark.range(1).select(
        T.content_tokens(F.lit("Tell me about Brightwater-three the the bridge")).alias("c"),
        T.mission_numbers(F.lit("mission two and 2 of 2008, 13")).alias("m"),
        T.proper_tokens(F.lit("India's Delphin lander of it")).alias("p"),
        T.spelled(F.lit("ABC3 WXYZ12 2008")).alias("s"),
        T.speaker_key(F.lit("Positive_x_NOVA1_003")).alias("k"),
        T.speaker_key(F.lit("abc_nohash_0")).alias("k2"),
        T.speaker_key(F.lit("noise")).alias("k3"),
        T.strip_unknown(F.lit(" [unk] ")).alias("u"),
        T.phrase_in(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("b"), F.lit("c"))).alias("in"),
    ).first()
    assert r.c == ["brightwater", "3", "bridge"] and r.m == ["2", "13"] and r.p == ["delphin"]
    assert r.s == ["abc", "three", "wxyz", "twelve", "2008"] and (r.k, r.k2, r.k3) == ("nova1", "abc", "") and r.u is None and r["in"]


def plain_fires(probs, theta, k, w, r):
    out, last = [], None
    for i in range(w - 1, len(probs)):
        if sum(p > theta for p in probs[i - w + 1 : i + 1]) >= k and (last is None or i - last >= r):
            out.append(i)
            last = i
    return out


def test_refractory_folds(spark):
    rng = np.random.default_rng(3)
    streams = {s: rng.random(n).round(3).tolist() for s, n in enumerate((0, 1, 4, 5, 60, 300))}
    df = spark.createDataFrame([(s, i, p) for s, ps in streams.items() for i, p in enumerate(ps)], "stream_id int, hop int, prob double")
    for theta, k, w, r in ((0.5, 3, 5, 10), (0.7, 1, 1, 3), (0.2, 2, 3, 1)):
        got = sorted(map(tuple, detect.detect(df, theta, k, w, r).collect()))
        assert got == [(s, h) for s, ps in streams.items() for h in plain_fires(ps, theta, k, w, r)]


def test_go_and_no_go_rows(spark):
    rows = [(s, i, p) for s, ps in (("go", [0.673, 0.949, 0.992, 0.988, 0.995]), ("no", [0.001, 0.028, 0.014, 0.187, 0.500])) for i, p in enumerate(ps)]
    got = detect.detect(spark.createDataFrame(rows, "stream_id string, hop int, prob double")).collect()
    assert [tuple(r) for r in got] == [("go", 4)]


def test_machine():
    m = sessions.Machine(0.5, 2, 3, 4, 0.1, 2, 5)
    probs = [0.9, 0.9, 0.9, 0, 0, 0, 0.9, 0.9, 0.9, 0, 0, 0, 0, 0]
    levels = [1, 1, 1, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1]
    assert [m.step(p, v) for p, v in zip(probs, levels, strict=True)] == [None, None, "wake", None, "end", None, None, None, "wake", None, None, None, None, "end"]


def test_capture():
    c = Capture(onset=10, drop=3, quiet=2, pre=1, tail=1, most=6)
    assert [x for x in map(c.step, [0, 0, 20, 8, 0, 0, 0, 20, 20, 20, 20, 20, 20]) if x] == [(1, 4, False), (6, 11, True)]


def test_wav_errors():
    with pytest.raises(ValueError):
        wav.wav_samples(wav.wav_bytes([1, 2], rate=8000))
    assert wav.wav_samples(wav.wav_bytes([0, 16384])).tolist() == [0.0, 0.5]


def test_contract_hash():
    assert len(params.contract_hash((("a", 1),))) == 16


KB = "id string, name string, aliases array<string>, descriptors array<string>, launch_date string, ord int"


def test_layers(spark):
    kb = spark.createDataFrame(
        [
            ("z1", "Zephyr-1", ["zephyr one"], ["wind mission"], "2008-10-22", 0),
            ("z3", "Zephyr-3", ["zephyr three"], ["wind mission", "cold wind mission"], "2023-07-14", 1),
            ("k", "Kestrel Orbiter", ["kestrel"], ["bird watcher"], None, 2),
        ],
        KB,
    ).withColumn("launch_date", F.col("launch_date").cast("date"))
    asks = {
        "tell me about the wind mission": ("z3", "descriptor"),
        "wind mission one": ("z1", "descriptor"),
        "zephyr three": ("z3", "fuzzy"),
        "zephyr 1": ("z1", "fuzzy"),
        "kestral": ("k", "fuzzy"),
        "what about it": (None, None),
        "mission": (None, None),
        "[unk]": (None, None),
    }
    got = Matcher(kb).match(spark.createDataFrame([(i, t) for i, t in enumerate(asks)], "query_id int, text string")).collect()
    assert {r.text: (r.id, r.layer) for r in got} == asks


def test_refractory_over_batches(spark):
    """Dense candidates of several groups, in Arrow batches that cut groups anywhere, against a plain loop."""
    from tidewell.operators import detect

    r = np.random.default_rng(6)
    rows = sorted({(float(t), int(g), int(h)) for t, g, h in zip(r.integers(0, 3, 900), r.integers(0, 5, 900), r.integers(0, 200, 900), strict=True)})
    want, last = set(), {}
    for t, g, h in rows:
        if (t, g) not in last or h - last[t, g] >= 7:
            last[t, g] = h
            want.add((t, g, h))
    df = spark.createDataFrame(rows, "theta double, stream_id int, hop int").repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("3", "40", was):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert {tuple(x) for x in detect.refractory(df, 7, ("theta", "stream_id")).collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_low_shelf_raises_the_bass_alone(spark):
    t = np.arange(16000) / 16000
    rows = [(f, (0.05 * np.sin(2 * np.pi * f * t)).tolist()) for f in (40, 60, 4000, 7000)]
    df = spark.createDataFrame(rows, "f int, x array<double>").select("f", "x", mfcc.low_shelf(10.0)("x").alias("y"))
    for r in df.collect():
        db = 10 * np.log10(np.mean(np.square(r.y[8000:])) / np.mean(np.square(r.x[8000:])))
        assert abs(db - (10 if r.f < 500 else 0)) < 0.4
