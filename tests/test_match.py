"""Layered entity resolution against a plain loop over queries and entities, and on named cases."""

import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions.similarity import metaphone, ratio, token_set_ratio
from tidewell.operators import match

KB = [
    ("delta", "Delphin-2 Orbiter", ["Delphin 2", "second river probe"], ["river sounding mission", "the ice mapper"], date(2019, 7, 22)),
    ("delta3", "Delphin-3", ["Delphin three"], ["river sounding mission", "soft landing craft"], date(2023, 7, 14)),
    ("gull", "Gullwing Observatory", ["Gullwing L1"], ["solar storm watcher", "sun watching craft"], date(2023, 9, 2)),
    ("wren", "Wrenfield Ground Station", ["WFGS"], ["deep dish antenna"], None),
    ("marl", "Marlowe Transporter", ["MTX", "Marlowe"], ["heavy lifting vehicle", "soft landing craft"], date(2017, 6, 5)),
    ("osprey", "Osprey 1A", [], [], date(2015, 4, 19)),
    ("osprey9", "Osprey 9", [], None, None),
    ("kestrel", "Kestrelon", ["Kestrelon crew capsule"], ["crew capsule program"], None),
]
ASKS = [
    "tell me about delphin two", "what is delphin three", "delphin 3", "delfin orbiter", "when was the gullwing observatory launched", "gull wing observatory", "what about the solar storm watcher",
    "which one is the sun watching craft", "the soft landing craft", "the river sounding mission", "river sounding mission number 2", "wrenfeld station", "ren field ground station", "w f g s", "where is the deep dish antenna",
    "heavy lifting vehicle", "m t x", "marlow transporter", "marlowe", "osprey one a", "osprey 9", "osprey nine", "osprey", "ospray", "ospry 1", "kestrelon", "kestralon capsule", "castrelon", "crew capsule program", "space mission", "india",
    "the rocket", "[unk]", "[unk] delphin [unk]", "", "how are you", "banana bread", "delphin nine", "second river probe", "ice mapper", "the ice mapper", "gulwing", "golwink", "marlo", "observatory", "orbiter", "station", "delphin's orbiter", "a b c",
    "what is the launch vehicle called marlowe", "watching the sun", "transporter", "mission two", "wfgs", "wf gs", "crew capsule", "deep dish", "osprey mission 1", "storm watcher solar", "kestrel on", "delphin delphin",
]


def words(t, pattern="[a-z0-9']+"):
    return re.findall(pattern, (t or "").lower())


def numbered(t):
    return [T.NUMBERS.get(w, w) for w in words(t)]


def numbers(t):
    return {w for w in numbered(t) if re.fullmatch("[0-9]{1,2}", w)}


def content(t, digits=True):
    own = numbered(t) if digits else words(t, "[a-z']+")
    return " ".join(w for w in own if w not in T.STOPWORDS)


def bare(t, without):
    own = [re.sub("'s?$", "", w) for w in words(t, "[a-z']+")]
    return [w for w in own if len(w) >= 3 and w not in without]


def collapsed(t):
    return re.sub(r"(?<=\b[a-z])\s+(?=[a-z]\b)", "", t)


class Plain:
    def __init__(self, kb, descriptors=True, guard=True, digits=True):
        self.kb, self.descriptors, self.guard, self.digits = kb, descriptors, guard, digits
        self.nums = [numbers(" ".join([n, *a])) if digits else set() for _, n, a, _, _ in kb]

    def agrees(self, q, i):
        return not q or not self.nums[i] or bool(q & self.nums[i])

    def names_one(self, flat):
        without = {*T.STOPWORDS, *T.CARRIERLESS, *T.ANCHORLESS}
        theirs = {w for _, n, a, _, _ in self.kb for x in [n, *a] for w in bare(x, without)}
        for a in bare(flat, without):
            if a in theirs or any(len(a) >= 5 and len(b) >= 5 and (ratio(a, b) >= 75 or a in b or b in a) for b in theirs):
                return True
        return False

    def descriptor(self, flat, q):
        toks, seen = words(flat), {}
        for i, (_, _, _, ds, _) in enumerate(self.kb):
            for j, d in enumerate(ds or []):
                p = tuple(words(d))
                if len(p) >= 2 and any(tuple(toks[k : k + len(p)]) == p for k in range(len(toks))):
                    seen.setdefault(p, []).append((i, j))
        if not seen:
            return None
        best = min(seen, key=lambda p: (-len(p), min(seen[p])))
        ids = [i for i, _ in seen[best] if self.agrees(q, i)]
        dated = [i for i in ids if self.kb[i][4]]
        if dated:
            return max(dated, key=lambda i: (self.kb[i][4], -i)), 0.6
        return (min(ids), 0.6) if ids else None

    def carried(self, a, b):
        without = {*T.STOPWORDS, *T.CARRIERLESS}
        return any(ratio(x, y) >= 70 or len(x) >= 4 and len(y) >= 4 and (x in y or y in x) for x in bare(a, without) for y in bare(b, without))

    def fuzzy(self, t, flat, q):
        found = []
        for v, x in enumerate(dict.fromkeys([t, flat])):
            c, best = content(x, self.digits), None
            for i, (_, n, a, _, _) in enumerate(self.kb):
                for pos, name in enumerate([n, *a]):
                    cand = " ".join(numbered(name)) if self.digits else name
                    s = token_set_ratio(c, cand) if c else 0
                    if s >= 65 and self.agrees(q, i) and (not self.guard or self.carried(c, cand)) and (best is None or (-s, i, pos) < best):
                        best = (-s, i, pos)
            if best:
                found.append((best[0], v, best[1]))
        return (min(found)[2], -min(found)[0] / 100) if found else None

    def phonetic(self, flat, q):
        count, first = {}, {}
        for at, a in enumerate(re.findall("[a-z]+", content(flat, False))):
            for i, (_, n, al, _, _) in enumerate(self.kb):
                for name in [n, *al]:
                    for b in re.findall("[a-z]+", name.lower()):
                        if len(a) >= 4 and len(b) >= 4 and b not in {*T.ANCHORLESS, "series"} and metaphone(a) == metaphone(b) and ratio(a, b) >= 60 and self.agrees(q, i):
                            count[i] = count.get(i, 0) + 1
                            first[i] = min(first.get(i, (99, 99)), (at, i))
        if not count:
            return None
        i = min(count, key=lambda i: (-count[i], first[i]))
        return i, min(0.5 + 0.15 * (count[i] - 1), 0.8)

    def match(self, text):
        t = re.sub(r"\[unk\]", " ", text or "").strip(" ")
        flat = collapsed(t)
        if not t or not content(flat, self.digits):
            return None, None, None
        q = numbers(flat) if self.digits else set()
        got = self.descriptor(flat, q) if self.descriptors and not self.names_one(flat) else None
        layer = "descriptor"
        if not got:
            got, layer = self.fuzzy(t, flat, q), "fuzzy"
        if not got:
            got, layer = self.phonetic(flat, q), "phonetic"
        return (self.kb[got[0]][0], round(got[1], 6), layer) if got else (None, None, None)


def frames(spark):
    kb = spark.createDataFrame([(i, n, a, d, x, o) for o, (i, n, a, d, x) in enumerate(KB)], "id string, name string, aliases array<string>, descriptors array<string>, launch_date date, ord int")
    return kb, spark.createDataFrame(list(enumerate(ASKS)), "query_id int, text string")


@pytest.mark.parametrize("config", [{}, {"use_descriptors": False}, {"generic_guard": False}, {"digit_aware": False}, {"use_phonetic": False}])
def test_equals_a_plain_loop(spark, config):
    kb, asks = frames(spark)
    plain = Plain(KB, config.get("use_descriptors", True), config.get("generic_guard", True), config.get("digit_aware", True))
    if not config.get("use_phonetic", True):  # the layer's means are missing
        plain.phonetic = lambda flat, q: None
    got = {r.query_id: (r.id, r.confidence and round(r.confidence, 6), r.layer) for r in match.Matcher(kb, **config).match(asks).collect()}
    want = {i: plain.match(t) for i, t in enumerate(ASKS)}
    assert {ASKS[i]: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert {x[2] for x in want.values()} >= {"fuzzy", None} and sum(x[0] is not None for x in want.values()) > 30


def test_named_cases(spark):
    kb, asks = frames(spark)
    got = {r.text: r for r in match.Matcher(kb).match(asks).collect()}
    for text, want in {"tell me about delphin two": "delta", "what is delphin three": "delta3", "the soft landing craft": "delta3", "osprey 9": "osprey9", "w f g s": "wren", "space mission": None, "[unk]": None, "": None, "banana bread": None}.items():
        assert got[text].id == want, text


def test_extra_words_carry_no_match(spark):
    kb, _ = frames(spark)
    asks = spark.createDataFrame([(1, "gullwing"), (2, "marlowe")], "query_id int, text string")
    with_, without = ({r.query_id: r.id for r in match.Matcher(kb, extra=e).match(asks).collect()} for e in ((), ("gullwing",)))
    assert with_ == {1: "gull", 2: "marl"} and without == {1: None, 2: "marl"}


def test_vectors(spark):
    kb, _ = frames(spark)
    r = np.random.default_rng(8)
    vec = r.normal(size=(len(KB), 16))
    ask = r.normal(size=(40, 16)) * 0.9 + vec[r.integers(0, len(KB), 40)]
    kb = kb.join(spark.createDataFrame([(k[0], v.tolist()) for k, v in zip(KB, vec, strict=True)], "id string, vec array<double>"), "id")
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ask)], "query_id int, vec array<double>")
    m = match.Matcher(kb, vectors=asks)
    got = {x.query_id: (x.id, x.confidence) for x in m.by_vector(m.prepared(asks.select("query_id", F.lit("some spoken query").alias("text")))).collect()}
    cos = (ask @ vec.T) / np.linalg.norm(ask, axis=1)[:, None] / np.linalg.norm(vec, axis=1)
    want = {i: KB[int(c.argmax())][0] for i, c in enumerate(cos) if c.max() >= 0.4}
    assert {i: x[0] for i, x in got.items()} == want and 0 < len(want) <= 40
    assert all(abs(got[i][1] - cos[i].max()) < 1e-9 for i in want)
