"""Collocations, licence scans and fill-in-middle against plain Python forms; nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from test_operators import EDGE, docs

from tidewell.llm import collocations, infill, licenses

# 11


def plain_counts(rows, least):
    """Counts of phrases by language, and of all words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    return {k: v for k, v in f.items() if v >= least}, n


def plain_collocations(rows, top, least):
    f, n = plain_counts(rows, least)
    gone = set()
    for (lang, w), c in f.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (lang, w[i : i + size])
                if 100 * c >= 100 * f[part]:
                    gone.add(part)
    best = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and (lang, w) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            best[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in best.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


SCHEMA = "text string, lang string, w string, id long, f long"


@pytest.mark.parametrize("shard", [40, 1 << 20])
def test_collocations_equal_plain_counts(spark, shard, monkeypatch):
    r = random.Random(shard)
    words = ["a", "b", "A", "é", "x\x00y", "zz\x1f", " ", "q-r", "the"]
    rows = [(r.choice(["en", "fr", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!?", " ,"]) for _ in range(r.randrange(60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, " \t\n"), ("en", "one two three four five six " * 30), ("fr", "x " * 400), ("en", "one two three four five six " * 30)]
    monkeypatch.setattr(collocations, "BLOCK", 100)
    df = spark.createDataFrame([(t, lang, "clash", 1, 2) for lang, t in rows], SCHEMA).repartition(5)
    got = collocations.collocations(df, top=25, least=6, size=shard).collect()
    want = plain_collocations(rows, 25, 6)
    assert len(want) > 60 and sorted((x.lang, x.rank, x.phrase, x.a, x.l, x.r, x.n, x.score) for x in got) == want


def test_suffix_array_counts_phrases():
    r = np.random.default_rng(5)
    for longest in 2, 3, 4, 5:
        ids = r.integers(0, 4, 3000)
        left = np.where(ids == 0, 0, collocations.room(np.append((ids[:-1] != 0) & (ids[1:] != 0), False)))
        want = Counter(tuple(ids[i : i + k]) for k in range(1, longest + 1) for i in range(len(ids) - k + 1) if 0 not in ids[i : i + k])
        got = {tuple(ids[s : s + k]): c for k, start, count in collocations.phrases(ids, left, 1, longest) for s, c in zip(start.tolist(), count.tolist(), strict=True)}
        assert got == dict(want)


def test_collocation_scores_pass_64_bits(spark):
    a, left, n = 4_000_000_000_007, 8_000_000_000_033, 9_000_000_000_000_011
    found = spark.createDataFrame([("en", [1], left), ("en", [2], left + 5), ("en", [1, 2], a)], "lang string, w array<long>, f long")
    (got,) = collocations.scored(found, spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    assert got.score == 1000 * a * n // (left * (left + 5)) and 1000 * a * n > 1 << 64


def test_collocations_of_nothing(spark):
    for texts in [], [(None, "en", "c", 1, 2), ("", None, "c", 1, 2)]:
        assert collocations.collocations(spark.createDataFrame(texts, SCHEMA)).collect() == []


# 12


def plain_parse(tokens):
    """Recursive descent over the grammar: (weight, kept, all), or None if the expression isn't whole."""
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def atom():
        nonlocal at
        word = peek()
        at += 1
        if word == "(":
            x = either()
            assert peek() == ")"
            at += 1
            return x
        assert word not in (None, ")", "and", "or", "with")
        return licenses.weight(word), [word], [word]

    def joint():
        nonlocal at
        x = atom()
        while peek() == "with":
            at += 1
            y = atom()
            assert len(x[2]) == len(y[2]) == 1 and " with " not in x[2][0] + y[2][0]
            name = [f"{x[2][0]} with {y[2][0]}"]
            x = (1 if x[0] == 2 else x[0], name, name)
        return x

    def both():
        nonlocal at
        x = joint()
        while peek() == "and":
            at += 1
            y = joint()
            x = (max(x[0], y[0]), x[1] + y[1], x[2] + y[2])
        return x

    def either():
        nonlocal at
        x = both()
        while peek() == "or":
            at += 1
            y = both()
            x = ((y if y[0] < x[0] else x)[0], (y if y[0] < x[0] else x)[1], x[2] + y[2])
        return x

    try:
        x = either()
        assert at == len(tokens)
    except AssertionError:
        return None
    return x


def test_shunting_yard_equals_recursive_descent():
    r, words, whole = random.Random(3), ["mit", "gpl-2.0-only", "lgpl-2.1", "x-1", "classpath-exception-2.0", "and", "or", "with", "(", ")"], 0
    for _ in range(20_000):
        tokens = r.choices(words, [4, 4, 3, 2, 2, 3, 3, 2, 2, 2], k=r.randrange(1, 10))
        order, want = licenses.postfix(tokens), plain_parse(tokens)
        got = licenses.evaluate(order) if order else None
        assert got == want, tokens
        whole += want is not None
    assert whole > 1000


@pytest.mark.parametrize(
    ("line", "labels", "valid", "obligation", "kept"),
    [
        ("SPDX-License-Identifier: MIT", ["mit"], True, "permissive", ["mit"]),
        ("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */ more", ["apache-2.0", "gpl-2.0-only", "mit"], True, "permissive", ["apache-2.0", "mit"]),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR LGPL-2.1-only", ["gpl-2.0-only with classpath-exception-2.0", "lgpl-2.1-only"], True, "weak", ["gpl-2.0-only with classpath-exception-2.0"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0 AND GPL-3.0-or-later", ["apache-2.0", "gpl-3.0-or-later", "mit"], True, "permissive", ["mit"]),
        ("SPDX-License-Identifier: GPL-2.0+ and others", ["gpl-2.0+"], True, "strong", ["gpl-2.0+"]),
        ("SPDX-License-Identifier: MIT. It is free", ["mit"], True, "permissive", ["mit"]),
        ("SPDX-License-Identifier: LicenseRef-Own-1", ["licenseref-own-1"], True, "unknown", ["licenseref-own-1"]),
        ("SPDX-License-Identifier: (MIT OR ISC", ["isc", "mit"], False, None, []),
        ("SPDX-License-Identifier: MIT OR\nISC", ["mit"], False, None, []),
        ('"License-Expression": "MIT OR ISC"', ["isc", "mit"], True, "permissive", ["mit"]),
    ],
)
def test_expressions(line, labels, valid, obligation, kept):
    _, _, (tag,) = licenses.Scanner().scan(f"é before\n{line}\nbehind")
    assert (tag["labels"], tag["valid"], tag["obligation"], tag["kept"]) == (labels, valid, obligation, kept)
    assert f"é before\n{line}\nbehind"[tag["start"] :].lower().startswith(("spdx", "license-expression"))


def test_prose_is_no_expression():
    for text in "The SPDX license identifier is short.", "License expression: as they like it", "SPDX-License-Identifier:\nMIT", "SPDX-License-Identifier: see file":
        assert licenses.Scanner().scan(text)[2] == []


def plain_places(text):
    """Base places and labels of notices, word by word."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = lambda phrases: [(i, len(p.split()), label) for p, label in phrases.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    base, notice = at(licenses.BASE), at(licenses.NOTICES)
    outer = [x for x in notice if not any(y[0] <= x[0] and x[0] + x[1] <= y[0] + y[1] and y[1] > x[1] for y in notice)]
    return len(ws), base, outer


def check_scan(rows):
    labels = 0
    for r in rows:
        n, base, notice = plain_places(r.text)
        own = {x[2] for x in base} | {x[2] for x in notice} | {y for t in r.tags for y in t.labels}
        starts = [x[0] for x in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(starts, default=None), max(starts, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted({x[2] for x in base})), ",".join(sorted(own)))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(own)
        for p in r.places:
            assert " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text[p.start : p.end].lower())) in licenses.BASE | licenses.NOTICES
        labels += len(own)
    return labels


def test_license_scan_equals_plain_places(spark):
    rows = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    found = licenses.labelled(licenses.scan(rows))
    assert check_scan(found.join(rows.select("doc_id", "text"), "doc_id").collect()) > 20


def test_license_scan_edges(spark):
    texts = [*EDGE, "MIT License mit license, the MIT\nLicense", "mit licenses amit license", "ÉMIT LICENSE", "Apache License, Version 2.0; General-Public-License", "gnu lesser general public license version 3", "Licensed under CC BY-NC 4.0.", "é " * 50_000 + "Apache License " * 300, "cc by nc sa 4 0 cc by nc", *["tie mit license"] * 2]
    df = docs(spark, texts)
    got = licenses.labelled(licenses.scan(df)).collect()
    by = {i: t for i, t in enumerate(texts)}
    assert len(got) == len(texts) + 2

    class Row(dict):
        __getattr__ = dict.__getitem__

    assert check_scan([Row(r.asDict() | {"text": by[r.doc_id]}) for r in got]) > 10
    assert {r.doc_id: r.labels for r in got}[len(EDGE) + 5] == "cc-by-nc-4.0"
    assert licenses.labelled(licenses.scan(df.limit(0))).collect() == []


# 13


def plain_infill(key, text):
    t = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, e = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    pre, mid, suf = ("".join(x) for x in (u[:a], u[a:e], u[e:]))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, None, t
    if h4 % 100 < 20:
        return len(u), "spm", pre, mid, suf, f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", pre, mid, suf, f"<P>{pre}<S>{suf}<M>{mid}"


def test_infill_equals_plain_form(spark):
    r = random.Random(13)
    alphabet = ["a", "B", "<", ">", "P", "S", "M", "<P", "S>", " ", "\n", "é", "\U0001f600", "0", "<M"]
    texts = [*EDGE, "<P>", "a <M> b", "<S", "<P><S", *("".join(r.choices(alphabet, k=r.randrange(1, 40))) for _ in range(400))]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(None, "no id here", "en", "s", None, "x", 1), (None, None, None, None, None, "x", 1)], docs(spark, ["", ""]).schema))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [*rows[-2:], (None, "no id here"), (None, None)]
    out = infill.arranged(df)
    got = out.select("*", infill.restored(out.output, out.form).alias("back")).collect()
    want = [(k, *plain_infill(k, t), t or "") for k, t in rows]
    key = lambda x: tuple(map(str, x))
    assert sorted([(x.doc_id, x.n, x.form, x.prefix, x.middle, x.suffix, x.output, x.back) for x in got], key=key) == sorted(want, key=key)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert infill.arranged(df.limit(0)).collect() == []


def test_infill_plan_is_one_pass(spark):
    plan = infill.query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("regexp_extract_all") == 1
