"""Operator 12: licence scans by one Aho-Corasick automaton and a shunting-yard parser.

The automaton holds phrases in normalised words (A-Z lower-cased, joined by
single spaces): base phrases, notice phrases of licence texts, and identifier
tags. Each text is scanned once, whole; places are mapped to words and, for the
spans, to the characters of the original text.

- A notice inside a longer notice's words gives no label of its own; base places
  always count.
- Behind an identifier tag and a colon or equals sign stands an expression of
  licence ids, `and`, `or`, `with` and parentheses (in any case). It is read as
  far as it makes sense: an operand that no licence id can be (prose going on)
  ends it before the operator that led to it. Shunting-yard turns it into postfix
  order (with binds closest, then and, then or), which is evaluated to the
  obligation that one can't avoid: `and` takes the heavier side, `or` the lighter
  (the left one of equals), `with` lightens a strong one to weak. Unclosed or
  dangling expressions are marked invalid and give their ids without evaluation.

Labels of ids are the ids in lower case ("gpl-2.0-only with
classpath-exception-2.0"); those of notices are in NOTICES. Score: one less the
product of what each kind of evidence leaves in doubt (DOUBT).

Nulls: a null text counts as empty: no words, no places, score 0. Very long
texts are scanned whole, in time that grows with their length. Repeated rows are
scanned row by row. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import kept, table
from tidewell.llm.decontaminate import fold

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words that announce an expression; only behind the first may it begin with an id that isn't known.
TAGS = ("spdx license identifier", "license expression")
#: Wordings of licence texts and of references to them, in normalised words.
_TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "bsd license": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl",
    "apache license version 2 0": "apache-2.0", "apache 2 0 license": "apache-2.0", "gnu gpl": "gpl",
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0", "version 2 of the gnu general public license": "gpl-2.0", "version 3 of the gnu general public license": "gpl-3.0",
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1", "gnu lesser general public license version 3": "lgpl-3.0", "gnu affero general public license version 3": "agpl-3.0",
    "mozilla public license": "mpl", "mozilla public license version 2 0": "mpl-2.0", "eclipse public license": "epl", "european union public licence": "eupl",
    "this is free and unencumbered software released into the public domain": "unlicense", "dedicated to the public domain": "public-domain", "cc0 1 0": "cc0-1.0",
}
_CC = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
NOTICES = _TEXTS | {f"{name} {version.replace('.', ' ')}".strip(): f"cc-{kind}-{version}".strip("-") for kind, long in _CC.items() for name in (f"cc {kind.replace('-', ' ')}", f"creative commons {long}") for version in ("", "2.0", "3.0", "4.0")}
#: Obligations from light to heavy, and the ids of each; others are unknown.
OBLIGATIONS = ("permissive", "weak", "strong", "unknown")
_OF = {
    "permissive": "mit mit-0 isc 0bsd bsd-2-clause bsd-3-clause apache-1.1 apache-2.0 zlib bsl-1.0 unlicense cc0-1.0 cc-by-3.0 cc-by-4.0 wtfpl psf-2.0 python-2.0 x11 ncsa postgresql",
    "weak": "lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cddl-1.1",
    "strong": "gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later eupl-1.2 cc-by-sa-3.0 cc-by-sa-4.0 osl-3.0",
}
WEIGHT = {i: OBLIGATIONS.index(kind) for kind, ids in _OF.items() for i in ids.split()}
#: What base places, notices, valid and invalid expressions leave in doubt.
DOUBT = {"base": 0.4, "notice": 0.2, "valid": 0.05, "invalid": 0.5}

_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?)")
_BEGIN = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
_BINDS = {"or": 1, "and": 2, "with": 3}


def weight(licence: str) -> int:
    """Place of an id in OBLIGATIONS; a plus (or any later version) changes nothing."""
    return WEIGHT.get(licence.removesuffix("+"), len(OBLIGATIONS) - 1)


def _operand(word: str, known: bool) -> bool:
    """Whether a word can be a licence id: a known one, or (unless only known ones count) one with a digit or a hyphen, as ids mostly have."""
    return word.removesuffix("+") in WEIGHT or (not known and word not in _BINDS and bool(re.search(r"[0-9-]", word)))


def read(raw: bytes, at: int, known: bool = False) -> tuple[list[str], int]:
    """Tokens of the expression at a byte, and where it ends: an operand is expected first and behind `(` and operators."""
    tokens: list[str] = []
    depth, wanted, end = 0, True, at
    while m := _TOKEN.match(raw, at):
        word = m[1].decode().lower()
        if wanted and word == "(":
            depth += 1
        elif wanted and (_operand(word, known) or (tokens and tokens[-1] == "with" and "exception" in word)):
            wanted = False
        elif not wanted and word in _BINDS:
            wanted = True
        elif not wanted and word == ")" and depth:
            depth -= 1
        else:  # prose goes on
            if wanted and tokens and tokens[-1] in _BINDS and word not in _BINDS and word not in "()":
                tokens.pop()
            return tokens, end
        tokens.append(word)
        at = m.end()
        end = end if wanted and word != "(" else at
    return tokens, end


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order; None if the expression isn't whole."""
    out: list[str] = []
    held: list[str] = []
    wanted = True
    for word in tokens:
        if word == "(":
            if not wanted:
                return None
            held.append(word)
        elif word == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held or wanted:
                return None
            held.pop()
        elif word in _BINDS:
            if wanted:
                return None
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[word]:
                out.append(held.pop())
            held.append(word)
            wanted = True
        else:
            if not wanted:
                return None
            out.append(word)
            wanted = False
    if wanted or "(" in held:
        return None
    return out + held[::-1]


def evaluate(order: list[str]) -> tuple[int, list[str], list[str]] | None:
    """(weight, licences that have to be kept, all licences) of an expression in postfix order; None where `with` joins no two ids."""
    held: list[tuple[int, list[str], list[str]]] = []
    for word in order:
        if word not in _BINDS:
            held.append((weight(word), [word], [word]))
            continue
        right, left = held.pop(), held.pop()
        if word == "with":
            if len(left[2]) != 1 or len(right[2]) != 1 or " with " in left[2][0] + right[2][0]:
                return None
            joint = [f"{left[2][0]} with {right[2][0]}"]
            held.append((1 if left[0] == 2 else left[0], joint, joint))
        elif word == "and":
            held.append((max(left[0], right[0]), left[1] + right[1], left[2] + right[2]))
        else:
            held.append((*(left if left[0] <= right[0] else right)[:2], left[2] + right[2]))
    return held[0]


def judge(tokens: list[str]) -> dict:
    """What an expression says: labels, whether it is whole, its obligation, and the licences that have to be kept."""
    order = postfix(tokens)
    got = evaluate(order) if order else None
    if got is None:
        return {"labels": sorted({w for w in tokens if w not in _BINDS and w not in "()"}), "valid": False, "obligation": None, "kept": []}
    return {"labels": sorted(set(got[2])), "valid": True, "obligation": OBLIGATIONS[got[0]], "kept": sorted(set(got[1]))}


class Scanner:
    """The automaton of all phrases and tags."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list] = {}
        for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
            for phrase, label in phrases.items():
                kinds.setdefault(phrase, []).append((kind, label))
        for phrase, what in kinds.items():
            self.automaton.add_word(f" {phrase} ", (phrase.count(" ") + 1, tuple(what)))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[dict], list[dict]]:
        """(words, places, tags) of a text. A place: label, kind, first word, words, start and end in characters."""
        folded = fold(text)
        words = folded.split()
        hay = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(hay.decode("latin-1"))) if words else []
        if not found:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(hay, np.uint8) == 32)
        last = np.searchsorted(spaces, [e for e, _ in found]) - 1
        hits = [(kind, label, int(e) - n + 1, n) for e, (_, (n, what)) in zip(last, found, strict=True) for kind, label in what]
        raw = (text or "").encode("utf-8", "surrogatepass")
        edges = np.diff(np.concatenate([[0], np.frombuffer(folded, np.uint8) != 32, [0]]).astype(np.int8))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters up to a byte
        chars = lambda b: int(lead[b - 1]) if b else 0
        places, tags, reach = [], [], {}
        for kind, _, first, n in hits:
            if kind == "notice":
                reach[first] = max(n, reach.get(first, 0))
        outer, most = {}, -1  # the notices that lie in no other one
        for first in sorted(reach):
            if first + reach[first] > most:
                most = first + reach[first]
                outer[first] = reach[first]
        for kind, label, first, n in hits:
            a, e = int(begin[first]), int(end[first + n - 1])
            if kind != "tag":
                if kind == "base" or outer.get(first) == n:
                    places.append({"label": label, "kind": kind, "first": first, "n": n, "start": chars(a), "end": chars(e)})
                continue
            if (m := _BEGIN.match(raw, e)) is None:
                continue
            tokens, to = read(raw, m.end(), " ".join(x.decode() for x in words[first : first + n]) != TAGS[0])
            if any(w not in _BINDS and w not in "()" for w in tokens):
                tags.append({"start": chars(a), "end": chars(to), "expression": " ".join(tokens)} | judge(tokens))
        return len(words), places, tags


PLACES = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("expression", pa.string()), ("labels", pa.list_(pa.string())), ("valid", pa.bool_()), ("obligation", pa.string()), ("kept", pa.list_(pa.string()))]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, places, tags), one for each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        scanner = kept("licences", Scanner)
        for b in batches:
            got = [scanner.scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], PLACES), pa.array([x[2] for x in got], FOUND)], names=["k", "n_words", "places", "tags"])

    place = "array<struct<label:string,kind:string,first:long,n:long,start:long,end:long>>"
    tag = "array<struct<start:long,end:long,expression:string,labels:array<string>,valid:boolean,obligation:string,kept:array<string>>>"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_words long, places {place}, tags {tag}").withColumnRenamed("k", key)


def labelled(found: DataFrame) -> DataFrame:
    """With the places' and expressions' labels in one string each, and the score."""
    base = F.filter("places", lambda x: x["kind"] == "base")
    first = F.transform(base, lambda x: x["first"])
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    own = F.concat(F.transform("places", lambda x: x["label"]), F.flatten(F.transform("tags", lambda x: x["labels"])))
    there = {"base": F.size(base) > 0, "notice": F.exists("places", lambda x: x["kind"] == "notice"), "valid": F.exists("tags", lambda x: x["valid"]), "invalid": F.exists("tags", lambda x: ~x["valid"])}
    doubt = F.lit(1.0)
    for k, on in there.items():
        doubt = doubt * F.when(on, DOUBT[k]).otherwise(1.0)
    obligation = F.array_max(F.transform(F.filter("tags", lambda x: x["valid"]), lambda x: F.array_position(F.array(*map(F.lit, OBLIGATIONS)), x["obligation"])))
    return found.withColumns({"n_base": F.size(base).cast("long"), "first_word": F.array_min(first), "last_word": F.array_max(first), "base_labels": text(F.transform(base, lambda x: x["label"])), "labels": text(own), "score": 1.0 - doubt, "n_tags": F.size("tags").cast("long"), "obligation": F.get(F.array(*map(F.lit, OBLIGATIONS)), (obligation - 1).cast("int"))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = labelled(scan(table(spark, sf_dir, "documents")))
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_tags", "obligation")
