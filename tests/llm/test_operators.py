"""The operators against SQL or brute force: driver tables, and nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import html
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from oracle import duck, same
from pyspark.sql import functions as F

from tidewell.llm import chat, components, decontaminate, encoding, htmltext, jaccard, langid, packing, quality, registry, sharding, shingle, tokens, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, k long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def docs(spark, texts):
    """Rows with clashing extra columns; ids count up, the last two rows repeat."""
    rows = [(i, t, "en", "s", None, "extra", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-2:], DOCS)


EDGE = [None, "", " \n\t ", "one", "a b c d", "a b c d", "A B C D e", "a b c d e", "x " * 60, LONG, "tie tie", "tie tie"]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    same(registry.QUERIES[name](spark, SMALL).toPandas(), duck(SMALL).sql(registry.SQL[name]).df())


# 1


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(three)
    rep = {i + j for i, w in enumerate(three) if n[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep)


def plain_line_fails(lines):
    """The line rules, line by line."""

    def alone(line):
        flat = re.sub(r"[ \t\n\x0B\f\r]+", " ", line).strip(" ")
        words = [w for w in flat.split(" ") if w]
        if not words:
            return False
        symbols = sum(c in "#*$%&<>!?" for c in line)
        if symbols >= 3 and 10 * symbols > sum(map(len, words)):
            return True
        if len(words) >= 30 and not re.search("[.!?:;,…。、，！？]", flat):
            return True
        seps = sum(c in "|»›·" for c in line)
        if seps >= 3 and 8 * seps >= len(words):
            return True
        if len(words) <= 12 and re.search(r"[^ ] (>|/|»|›|→) [^ ].* (>|/|»|›|→) [^ ]", flat):
            return True
        return len(words) <= 40 and any(p in line.lower() for p in quality.BOILERPLATE)

    def short(line):
        words = line.split()
        return 0 < len(words) <= 4 and words[-1][-1] not in '.!?:;,…"”»)。！？'

    bad = [alone(x) for x in lines]
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and short(lines[end]):
            end += 1
        if end - at >= 5:
            bad[at:end] = [True] * (end - at)
        at = max(end, at + 1)
    return bad


def plain_judge(text):
    """Whether a text is kept, and what is left of it."""
    n, *_, rep = plain_quality(text)
    lines = (text or "").split("\n")
    bad = plain_line_fails(lines)
    total, lost = sum(map(len, lines)), sum(len(x) for x, b in zip(lines, bad, strict=True) if b)
    return not (n < 50 or 2 * rep > n or 100 * lost > 40 * total), "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)


def test_quality_equals_plain_rules(spark):
    rows = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    got = quality.judge(rows).collect()
    assert len(got) == 1000 and 0 < sum(r.kept for r in got) < 1000
    for r in got:
        assert (r.kept, r.clean_text or "") == plain_judge(r.text), r.doc_id


def test_quality_counts(spark):
    texts = [*EDGE, "a b a b a b", "l1 x\nl1 x\n\nl1 x\n" * 3, "é# *ñ"]
    for r in quality.judge(docs(spark, texts)).collect():
        want = plain_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 2 * want[4] > want[0])
        assert not (r.base_failed and r.kept)


def test_quality_line_rules(spark):
    good = "\n".join(" ".join(f"Word{i}{c}" for c in "abcdefghijk") + "." for i in range(8))
    cases = {
        "Home > Shop > Shoes": False, "Start » Artikel » Neu": False, "He walked to the A > B > C junction and then he turned around once more.": True, "either / or": True,
        "Alle Rechte vorbehalten.": False, "Política de privacidad": False, "Tous droits réservés.": False, "Mentions légales": False,
        " ".join(f"spam{i}" for i in range(40)): False, " ".join(f"prose{i}," for i in range(40)): True, "A heading": True,
        "Home\nNews\nAbout us\nContact\nLog in": False, "Home\nNews\nAbout us\nContact": True, "Yes.\nNo.\nWhy?\nAh!\nSo.": True, "a\n\nb\n\nc\n\nd\n\ne": True,
    }
    got = {r.doc_id: r.clean_text for r in quality.judge(docs(spark, [f"{good}\n{x}\n{good}" for x in cases])).collect()}
    for i, (x, stays) in enumerate(cases.items()):
        assert got[i] == (f"{good}\n{x}\n{good}" if stays else f"{good}\n{good}"), x


def test_quality_clashing_columns(spark):
    cols = ["n_words", "kept", "_w", "_l", "n_symbols", "clean_text", "base_failed", "r", "t"]
    df = docs(spark, ["a b", "c d"]).select("doc_id", "text", *[F.lit(1).alias(c) for c in cols])
    assert quality.clean(df).columns == df.columns and quality.clean(df).count() == 0
    assert quality.clean(df.withColumn("text", F.repeat("text", 60))).count() == 0


def test_quality_lines(spark):
    good = "\n".join(" ".join(f"Word{i}{c}" for c in "abcdefghijk") + "." for i in range(8))
    menu = "\n".join(f"Home{i} | News{i} | About{i} | Contact{i} | Login{i}" for i in range(30))
    junk = "\n".join(f"wo{i}rd*** so{i}me### th{i}ing%%% mo{i}re&&&" for i in range(40))
    small = "Licensed under CC BY 4.0.\n" + good + "\nHome | News | About | Contact"
    rows = {r.doc_id: r for r in quality.judge(docs(spark, [good, menu, junk, small, "", ""])).collect()}
    assert [rows[i].kept for i in range(4)] == [True, False, False, True] and not any(r.base_failed for i, r in rows.items() if i < 4)
    assert rows[3].clean_text == good
    kept = quality.clean(docs(spark, [good, menu, "", ""]))
    assert kept.columns == docs(spark, [good, good]).columns and [r.text for r in kept.collect()] == [good]
    assert quality.judge(docs(spark, [good, good]).limit(0)).count() == 0


# 2


def plain_components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def family(seed, n, size, edits):
    """Copies of one text with `edits` words changed each, and chains of copies of copies."""
    r = np.random.default_rng(seed)
    base, out = [f"s{seed}w{i}" for i in range(size)], []
    for i in range(n):
        t = list(base if i % 3 else (out[-1].split() if out else base))
        for j in r.integers(0, size, edits):
            t[j] = f"e{i}x{j}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("few,cell", [(8, 4_000_000), (2, 4_000_000), (2, 400), (1, 100)])
def test_jaccard_equals_all_pairs(spark, monkeypatch, few, cell):
    """Also with blocks that are never listed in pairs, and with cells dealt out in chunks."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "CELL", cell)
    shared = " ".join(f"passage{i}" for i in range(60))
    texts = [*EDGE[:9], *family(1, 25, 80, 2), *family(2, 15, 120, 4), *family(3, 12, 40, 1), *(f"{shared} " + " ".join(f"u{i}v{j}" for j in range(25)) for i in range(20)), "end of rows", "end  of ROWS"]
    df = docs(spark, texts)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == {(i, *v) for i, v in plain_components(dict(enumerate(texts))).items()}


def test_jaccard_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df).collect()), key=str) == sorted([(None, 2, None), (3, 2, 2), (2, 2, 2), (2, 2, 2), (1, 0, 1)], key=str)
    assert jaccard.join(df.limit(0)).count() == 0


def test_any_order_of_shingles_gives_the_same(spark, monkeypatch):
    texts = [*family(5, 20, 60, 2), "x", "x"]
    want = plain_components(dict(enumerate(texts)))
    plain = jaccard._ranks
    for seed in range(3):
        other = np.random.default_rng(seed).integers(0, 256, 1 << jaccard.BITS).astype(np.uint8)
        monkeypatch.setattr(jaccard, "_ranks", lambda *a, o=other: (o, *plain(*a)[1:]))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts)).collect()} == want


def test_tree_loses_no_pair():
    r = np.random.default_rng(1)
    vec = r.poisson(3, (300, 32))
    vec[150:] = np.maximum(vec[:150].astype(int) + r.integers(-1, 2, (150, 32)), 0)
    n = vec.sum(axis=1).astype(np.int64)
    got = {(a, b) for x, y in jaccard.CountTree(vec, n).pairs() for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    bound = np.minimum(vec[:, None], vec[None]).sum(axis=2)
    ok = (bound >= jaccard.need2(n[:, None], n[None])) & jaccard.fits(n[:, None], n[None])
    want = {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(ok)), strict=True) if a != b}
    assert want and want <= got


def test_links_in_a_cell():
    """The search of a cell joins what all pairs join, with fewer links than members; also without bit rows."""
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    own = [np.unique(np.concatenate([r.choice(base, r.integers(200, 300), replace=False), r.integers(0, 1 << 63, r.integers(0, 60), dtype=np.uint64)])) for _ in range(70)]
    n = np.array([len(s) for s in own])
    both = np.array([[len(np.intersect1d(a, b)) for b in own] for a in own])
    linked = 100 * both >= 75 * (n[:, None] + n[None] - both)
    want = np.arange(70)
    for _ in range(70):
        want = np.array([want[row].min() for row in linked])
    assert 1 < len(set(want)) < 70
    for bits in (jaccard.BITSET, 0):
        jaccard.BITSET, was = bits, jaccard.BITSET
        links = jaccard.search(own, n, np.arange(70), 3)
        jaccard.BITSET = was
        assert len(links) < 70 and all(linked[a, b] for a, b in links)
        label = np.arange(70)
        for a, b in links:
            label[label == max(label[a], label[b])] = min(label[a], label[b])
        assert (label == want).all()


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes, wherever ranges of bytes are cut."""
    texts = [None, "", " ", "a", " a b", "A b  C\td\ne f", " x" * 300, "longword" * 40 + " b c d e f g " * 30, "é ü ÀB", None, "q w e r t y u i o p a s d f g h j k l" * 9, LONG]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    whole, n = shingle.word_hashes(pa.array(texts))
    assert n.tolist() == list(map(len, want))
    assert len(set(zip(whole.tolist(), sum(want, []), strict=True))) == len(set(whole.tolist())) == len(set(sum(want, [])))
    for size in (1, 7, 50):
        monkeypatch.setattr(shingle, "RANGE", size)
        monkeypatch.setattr(shingle, "_POWERS", {})
        got, n = shingle.word_hashes(pa.array(["x", *texts]).slice(1))
        assert (got == whole).all() and n.tolist() == list(map(len, want))


def test_tree_is_searched_on_the_driver_tables(spark, monkeypatch):
    """Documents of the driver's tables go through the tree."""
    rows = []
    dealt = jaccard._dealt
    monkeypatch.setattr(jaccard, "_dealt", lambda cells, *a: rows.append(cells.count()) or dealt(cells, *a))
    assert jaccard.join(spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")).count() == 1000
    assert rows[0] > 10


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.v: r.label for r in components.components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# 3 and 5


def test_parts_keep_the_ids():
    p = encoding.Pieces(encoding.default_path())
    r = np.random.default_rng(4)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'s", "12", "!", "é", "<|endoftext|>", "\x1c", "\x85", "日本", "😀", "\x00", "\u200b"]
    texts = ["".join(bits[i] for i in r.integers(0, len(bits), n)) for n in r.integers(0, 25, 4000)]
    texts += ["".join(map(chr, r.integers(1, 0xD7FF, 8))) for _ in range(2000)]
    want = [e.ids for e in p.tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in p.encode(texts)] == want
    assert all(p.ranks.encode_ordinary(t) == w for t, w in zip(texts, want, strict=True) if "<|end" not in t)


def test_chunks_resynchronise():
    tok = encoding.tokenizer(encoding.default_path())
    r = np.random.default_rng(5)
    bits = ["a", "word ", " ", "  ", "\n", " the", " of", "'s", "1", "é", "<|endoftext|>"]
    for n in r.integers(0, 400, 150):
        t = "".join(bits[i] for i in r.integers(0, len(bits), n))
        spans = list(tokens.chunked(t, tok, int(r.integers(5, 100)), int(r.integers(2, 20))))
        assert [x for _, _, ids in spans for x in ids] == tok.encode(t, add_special_tokens=False).ids
        assert "".join(t[a:b] for a, b, _ in spans) == t
    for t in ("x" * 500, " " * 300, "ab\n" * 200):
        assert tokens.count(t, tok, 20, 4) == len(tok.encode(t, add_special_tokens=False).ids)


def test_token_counts(spark):
    tok = encoding.tokenizer(encoding.default_path())
    for r in tokens.token_counts(docs(spark, EDGE)).collect():
        t = EDGE[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) and r.over_limit == (r.n_tokens > 512)
    assert tokens.token_counts(docs(spark, EDGE).limit(0)).count() == 0


def check_packing(rows, texts, size=2048):
    tok = encoding.tokenizer(encoding.default_path())
    by_seq = {}
    pieces = Counter()
    for r in rows:
        ids = np.array(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.length) == packing.cut(len(ids), size)[r.piece]
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id] += 1
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(by_seq), pieces


def test_packing(spark):
    rows = packing.packed(docs(spark, EDGE)).collect()
    n, pieces = check_packing(rows, EDGE)
    assert n == -(-sum(r.length for r in rows) // 2048) and set(pieces) == set(range(len(EDGE)))
    assert pieces[len(EDGE) - 1] == 2  # a repeated row is packed twice
    assert packing.packed(docs(spark, EDGE).limit(0)).count() == 0


def test_plan_is_best_fit_decreasing():
    r = np.random.default_rng(2)
    for size in (10, 37, 100):
        lengths = r.integers(1, size + 1, 400)
        plan = packing.plan(dict(Counter(lengths.tolist())), size)
        gaps = []
        for x in sorted(lengths, reverse=True):
            fit = [g for g in gaps if g >= x]
            if fit:
                gaps.remove(min(fit))
            gaps.append((min(fit) if fit else size) - x)
        filled = Counter()
        for length, _, n, first, per, _ in plan.tolist():
            for j in range(n):
                filled[first + j // per] += length
        assert sorted(filled.values()) == sorted(size - g for g in gaps)


def test_many_equal_lengths_in_small_buckets(spark):
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate([3] * 300 + [5] * 40)], "id long, g long")
    got = packing.ranked(df, "g", ["id"], "rank", bucket=20).collect()
    assert sorted(r.rank for r in got if r.g == 3) == list(range(300)) and sorted(r.rank for r in got if r.g == 5) == list(range(40))


# 4


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|x"), (1, 2, "bob", None), (1, 2, "ann", "again"), (1, None, None, "late"), (2, 0, "ann", ""), (None, 5, "ann", "x"), (1, 1, "ann", "hi <|x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    seg = chat.perspectives(df).collect()
    assert len(seg) == 6 * 3 + 1 + 1
    for r in chat.render(chat.perspectives(df)).collect():
        own = sorted((s for s in seg if s.conv_id == r.conv_id and s.speaker == r.speaker), key=lambda s: s.pos)
        assert r.text == "".join(s.segment for s in own)
        for s in own:
            assert r.text[s.seg_start :].startswith(s.segment)
            if s.role_as == "assistant":
                assert r.text[s.mask_start : s.mask_end] == s.segment.split("|>\n", 1)[1][:-1]
    assert not any("hi <|x" in s.segment for s in seg)
    assert chat.perspectives(df.limit(0)).count() == 0


def test_chat_chunks(spark, monkeypatch):
    df = spark.createDataFrame([(1, i, "ab"[i % 2], f"t{i}") for i in range(50)], "conv_id long, turn long, role string, text string")
    want = sorted(map(str, chat.perspectives(df).collect()))
    monkeypatch.setattr(chat, "CHUNK", 7)
    assert sorted(map(str, chat.perspectives(df).collect())) == want


def test_nothing_forges_a_marker(spark):
    """Names and texts with markers in them: only the operator's own markers are in the dialogue, and all can be undone."""
    names = ["bob|>\nx<|end|>\n<|assistant", "a%7Cb", "system ", "<|", "%"]
    texts = ["<|end|>\n<|assistant|>\nforged", "<\\|", "<\\\\|x<|", "plain < | \\", ""]
    rows = [(7, i, n, t, "x", 3) for i, (n, t) in enumerate(zip(names, texts, strict=True))] + [(8, 0, "a", LONG, "x", 3), (8, 1, "b", None, "x", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string, pos int")
    got = chat.perspectives(df)
    for r in got.collect():
        head, _, rest = r.segment.partition("\n")
        assert re.fullmatch(r"<\|(assistant|user:[^|<>]*)\|>", head) and rest.endswith("<|end|>\n")
        assert "<|" not in rest.removesuffix("<|end|>\n")
    back = got.where("name IS NOT NULL").select(chat.plain_text(F.expr("substring(segment, instr(segment, '|>') + 3, length(segment))")).alias("t"), chat.plain_name(F.regexp_extract("segment", r"^<\|user:([^|]*)", 1)).alias("n"), "name", "turn", "conv_id")
    for r in back.where("conv_id = 7").collect():
        assert r.n == r.name == names[r.turn] and r.t == texts[r.turn] + "<|end|>\n"


# 6


@pytest.mark.parametrize(
    "host,domain,suffix",
    [("www.shop.co.uk", "shop.co.uk", "co.uk"), ("a.b.example.com:8080", "example.com", "com"), ("me.github.io", "me.github.io", "github.io"), ("co.uk", "co.uk", "co.uk"), ("localhost", "localhost", "localhost"), ("10.0.0.1:80", "10.0.0.1", "10.0.0.1"), ("", "", "")],
)
def test_domain_levels(spark, host, domain, suffix):
    got = spark.createDataFrame([(host,)], "h string").select(*urls.levels(F.col("h"))).first()
    assert tuple(got) == (domain, suffix)


def test_urls(spark):
    cases = {
        None: ("", "", None),
        "no scheme.com/": ("", "", None),
        "https://X.Example.COM/en/a?b#c": ("x.example.com", "/en/a", "example.com/en/"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "http://a.com": ("a.com", "", None),
        "http://a.com?x/y": ("a.com", "", None),
        "ftp://a.net/es/1": ("a.net", "/es/1", "net/es/"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/"),
        "a://b://c.com/": ("b:", "//c.com/", None),
        "http://É.com/": ("É.com", "/", "com/"),
    }
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "id long, bad boolean")
    got = {r.page_id: r for r in urls.filtered(pages, none).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == want
        assert got[i].verdict == ("block" if want[2] in ("example.com/en/", "net/es/", "net/fr/") else "allow")
    assert urls.filtered(pages.limit(0), none).count() == 0


def test_reputation_blocks_bad_hosts(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.site.org/{i}") for i in range(200)] + [(900, "http://new.other.org/")], "page_id long, url string")
    out = spark.createDataFrame([(i, i % 2 == 1) for i in range(150)], "id long, bad boolean")
    got = {r.page_id: r for r in urls.filtered(pages, out, rules=[]).collect()}
    assert got[1].verdict == "block" and got[0].verdict == "allow" and got[900].verdict == "allow"
    assert 0.1 < got[900].bad_rate < 0.9


# 7


def test_decontamination(spark):
    bench = [(1, "Alpha beta, gamma."), (2, " ".join(f"w{i}" for i in range(20))), (3, None), (4, "!!"), (2, "alpha BETA"), (5, "é1 ñ")]
    texts = [None, "", "x alpha-beta/gamma y", " ".join(f"W{i}" for i in range(13)), "z " * 300 + " ".join(f"w{i}" for i in range(5, 19)), "é1 ñ é1 Ñ", "alpha beta alpha beta gamma", LONG, "end", "end"]  # the last two rows repeat
    items = spark.createDataFrame(bench, "item_id long, text string")
    for most in (decontaminate.MAX_WINDOWS, 10):  # one automaton, and several
        found = decontaminate.find(docs(spark, texts), items, max_windows=most)
        for r in decontaminate.judged(found).withColumn("sha", F.sha2(F.array_join("items", ","), 256)).collect():
            assert (r.n_words, r.n_hit, r.n_items, r.sha, r.contaminated) == decontaminate.brute(texts[r.doc_id], bench)
            if r.doc_id == 2:
                assert [texts[2][s.start : s.end] for s in r.spans] == ["alpha-beta/gamma"]
    kept = decontaminate.clean(docs(spark, texts), items)
    assert kept.columns == docs(spark, texts).columns and sorted({r.doc_id for r in kept.collect()}) == [0, 1, 4, 7, 8, 9]
    assert decontaminate.find(docs(spark, texts), items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find(docs(spark, texts).limit(0), items).count() == 0


def test_several_automata_over_many_batches(spark):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(12)], "item_id long, text string")
    rows = [(i, " ".join(f"i{i % 12}w{j}" for j in range(2, 18))) for i in range(300)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    got = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), items, max_windows=200).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert all((r.n_hit, r["items"]) == (16, [str(r.doc_id % 12)]) for r in got) and len(got) == 300


def test_items_without_an_id_give_hits(spark):
    items = spark.createDataFrame([(None, "alpha beta gamma"), (None, "other words"), (1, "delta")], "item_id long, text string")
    texts = ["alpha beta gamma", "delta other words", "none", "none"]
    for most in (decontaminate.MAX_WINDOWS, 4):
        got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in decontaminate.judged(decontaminate.find(docs(spark, texts), items, max_windows=most)).collect()}
        assert got == {0: (3, [], True), 1: (3, ["1"], True), 2: (0, [], False), 3: (0, [], False)}
    assert {r.doc_id for r in decontaminate.clean(docs(spark, texts), items).collect()} == {2, 3}


# 8


CASES = [
    ("<html><body><nav><a>x</a></nav><article><h1>T &amp; u</h1><p><b>A b<br>c<p>D  e</p></article><footer>f</footer>", "T & u\n\nA b c\n\nD e"),
    ("<div class='ad'>no<article><p>yes</p></article></div>", "yes"),
    ('<p>plain <i>in</i>line<div>two</div><div class="cookie-notice">c</div>', "plain inline\n\ntwo"),
    ("<main><p>m</p><section id=comments><p>c</p></section><aside>a</aside><form>q<input></form></main>", "m"),
    ("", ""),
    (None, ""),
    ("<", "<"),
    ("a < b &lt; c", "a < b < c"),
    ("<article><p>x<script>var t='</p>';</script>y</p><style>p{}</style>", "xy"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a\n\nb\n\n1\n\n2"),
    ("<nav><ul><li>x<article><p>kept</p></article>", "kept"),
    ("<article><p>a<!-- c --> b &copy; &#233; &nbsp; z</p><p", "a b © é z"),
    ("<article><p>hi <span class='share'>s<span>t</span>u</span> there</p></article>", "hi there"),
    ('<article><a href="x>y">link</a> t</article>', "link t"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_extract(page, want):
    assert htmltext.extract(page) == want


def test_templates_are_deleted(spark):
    rows = [(i, f"http://{h}/{i}", f"<body><div><p>Same on every page of {h}</p></div><p>Own text {i}</p><article></article></body>".replace("<article></article>", "")) for h in ("a.org", "b.org") for i in range(8)]
    rows += [(100, None, None), (101, "http://c.org/", "<p>Same on every page of a.org</p>")]
    got = {(r.url, r.page_id): r for r in htmltext.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, u, _ in rows[:-2]:
        assert got[(u, i)].text == f"Own text {i}"
    assert got[(None, 100)].text == "" and got[("http://c.org/", 101)].n_chars == 27


def html_texts(spark, rows):
    return {r.page_id: r.text for r in htmltext.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_are_no_template(spark):
    page = "<body><div><p>First of the text.</p><p>Second of it.</p></div></body>"
    rows = [(i, f"http://a.org/{i}", f"<nav>n{i}</nav>{page}") for i in range(8)] + [(8, "http://a.org/8", page)] * 3
    rows += [(20 + i, None, f"<p>No site at all</p><p>own {i}</p>") for i in range(8)]
    got = html_texts(spark, rows)
    assert {got[i] for i in range(9)} == {"First of the text.\n\nSecond of it."}
    assert all(got[20 + i] == f"No site at all\n\nown {i}" for i in range(8))


def test_templates_of_a_small_section(spark):
    rows = [(i, f"{'' if i % 2 else 'http://'}a.org/{i}", ("<div>Of the section</div><div>Of the section</div>" if i < 6 else "") + f"<p>Own {i}</p>") for i in range(60)]
    got = html_texts(spark, rows)
    assert all(got[i] == f"Own {i}" for i in range(60))


@pytest.mark.parametrize("tag,most", [("article", 1_000_000), ("main", 1_000_000), ("article", 0)])
def test_templates_inside_articles(spark, monkeypatch, tag, most):
    """Also where the hashes that recur are too many for a broadcast."""
    monkeypatch.setattr(htmltext, "BROADCAST_ROWS", most)
    rows = [(i, f"http://a.org/{i}", f"<{tag}><div><p>Same on every page of a.org</p></div><p>Own text of page {i}</p><p>Read more of us</p></{tag}>") for i in range(8)]
    assert html_texts(spark, rows) == {i: f"Own text of page {i}" for i in range(8)}


@pytest.mark.parametrize("edits", [0, 1, 6])
def test_near_copies_of_an_article_stay(spark, edits):
    r = np.random.default_rng(edits)
    rows, want = [], {}
    for i in range(30):
        paras = [[f"w{p}x{j}" for j in range(25)] for p in range(8)]
        for p, j in zip(r.integers(0, 8, edits), r.integers(0, 25, edits), strict=True):
            paras[p][j] = f"e{i}x{j}"
        want[i] = "\n\n".join(map(" ".join, paras))
        rows.append((i, f"http://a.org/{i}", f"<nav>n{i}</nav><article>" + "".join(f"<p>{' '.join(x)}</p>" for x in paras) + "</article>"))
    assert html_texts(spark, rows) == want


def test_words_of_classes_are_whole_tokens():
    prose = "<div class='side-effects'>A</div><section id='social-science'>B</section><p class='notice-of-appeal'>C</p><div class='share-prices'>D</div>"
    noise = "<div class='site-sidebar left'>x</div><ul class='nav-main'><li>y</li></ul><div id='comments-area-2'>z</div><div class='ad-300'>v</div><p class=cookie-notice>w</p>"
    assert htmltext.extract(f"<article>{prose}{noise}</article>") == "A\n\nB\n\nC\n\nD"


def test_deep_and_long_pages(spark):
    deep = "<ul>" * 50_000 + "deep" + "</div>" * 50_000 + "</ul>" * 49_000 + "<p>end</p>"
    long = "".join(f"<p>Paragraph {i} of it &amp; more.</p>" for i in range(60_000))
    rows = [(1, "http://a.org/1", deep), (2, "http://a.org/2", long), (2, "http://a.org/2", long), (3, "http://a.org/3", "")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, host string, k int")
    got = sorted(map(tuple, htmltext.texts(df).select("page_id", "text", "n_chars").collect()))
    text = "\n\n".join(f"Paragraph {i} of it & more." for i in range(60_000))
    assert got == [(1, "deep\n\nend", 9), (2, text, len(text)), (2, text, len(text)), (3, "", 0)]
    assert htmltext.texts(df.limit(0)).count() == 0


def plain_templates(pages):
    """By brute force, for pages without articles: texts of blocks directly in the body that are on 5 pages of distinct text of a host."""
    split = {i: (h, re.findall(r"<div>(.*?)</div>", x)) for i, (h, x) in enumerate(pages)}
    where = {}
    for h, blocks in split.values():
        for b in blocks:
            where.setdefault((h, b), set()).add(tuple(blocks))
    return {i: "\n\n".join(b for b in blocks if len(where[h, b]) < 5) for i, (h, blocks) in split.items()}


def test_templates_equal_brute_force(spark):
    r = np.random.default_rng(4)
    pages = [(f"h{r.integers(0, 4)}.org", "<body>" + "".join(f"<div>block {x}</div>" for x in r.zipf(1.5, r.integers(1, 6)).clip(0, 300)) + "</body>") for _ in range(300)]
    pages += [pages[0]] * 9
    want = plain_templates(pages)
    assert html_texts(spark, [(i, f"http://{h}/{i}", x) for i, (h, x) in enumerate(pages)]) == want
    assert 20 < sum(len(t) > 0 for t in want.values()) and any(t.count("block") < x.count("<div>") for t, (_, x) in zip(want.values(), pages, strict=True))


def test_articles_of_the_driver_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in htmltext.query(spark, SMALL).collect():
        own = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>", own)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# 9


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    p = sharding.Permutation(n)
    x = p.forth(np.arange(n))
    assert sorted(x) == list(range(n)) and (p.back(x) == np.arange(n)).all()


def test_sharding(spark, monkeypatch):
    texts = [*EDGE, *map(str, range(200))]
    df = docs(spark, texts)
    rows = sharding.sharded(df).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) + 2 and max(n.values()) - min(n[s] for s in range(16)) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
    again = sharding.sharded(df.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.row, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert sharding.sharded(df.limit(0)).count() == 0


# 10


def test_gradients():
    net = langid.Network(["a", "b", "c"], embed=3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, size = langid.encode([b"ab", b"xyz", b"q"], 5)
    y = np.array([0, 2, 1])
    _, g = net.gradients(x, size, y)
    r = np.random.default_rng(0)
    for k in net.p:
        for _ in range(5):
            i = tuple(int(r.integers(0, s)) for s in net.p[k].shape)
            i = (int(x[0, 1]), i[1]) if k == "E" else i
            o, e = net.p[k][i], 1e-3
            net.p[k][i] = o + e
            a = net.gradients(x, size, y)[0]
            net.p[k][i] = o - e
            b = net.gradients(x, size, y)[0]
            net.p[k][i] = o
            assert abs((a - b) / (2 * e) - g[k][i]) < 1e-4


def plain_log_probs(net, word):
    """The network's forward pass written out: one byte, one gate at a time."""
    p, h = net.p, net.h
    sig = lambda v: 1 / (1 + np.exp(-v))
    codes = [b + 1 for b in b" " + word + b" "]
    states = {}
    for d, order in (("f", range(len(codes))), ("b", range(len(codes) - 1, -1, -1))):
        s = np.zeros(h)
        for t in order:
            e, new = p["E"][codes[t]], np.zeros(h)
            for i in range(h):
                gate = [e @ p["W" + d][:, k * h + i] + p["b" + d][k * h + i] for k in range(3)]
                u = [s @ p["U" + d][:, k * h + i] for k in range(3)]
                z, r = sig(gate[0] + u[0]), sig(gate[1] + u[1])
                new[i] = z * s[i] + (1 - z) * np.tanh(gate[2] + r * u[2])
            s = new
            states[d, t] = s
    out = []
    for t in range(len(codes)):
        s = np.concatenate([states["f", t], states["b", t]]) @ p["V"] + p["c"]
        out.append(s - np.log(np.exp(s).sum()))
    return np.array(out)


def test_forward_pass():
    net = langid.Network(["a", "b", "c"], embed=4, hidden=5)
    words = [b"x", "ñandú".encode(), b"longer-word"]
    x, size = langid.encode(words, 20)
    got = net.log_probs(x, size)
    for i, w in enumerate(words):
        want = plain_log_probs(net, w)
        assert np.allclose(got[i, : size[i]], want, atol=1e-5) and np.allclose(net.pooled(words)[i], want.sum(axis=0), atol=1e-4)


def test_segments_end_between_characters():
    for text in ("漢字" * 40, "é" * 100, "a" * 97, "x" + "ж" * 60, "👍" * 30):
        parts = langid.words_of(text)
        assert b"".join(parts).decode() == text and all(p.decode() and len(p) <= langid.SEGMENT for p in parts)


def test_language_edges(spark):
    net = langid.Network(["de", "en"])
    rows = langid.identify(docs(spark, [*EDGE, "123 !!", "日本語"]), net=net).collect()
    for r in rows:
        t = [*EDGE, "123 !!", "日本語"][r.doc_id]
        assert (r.lang_pred == "und") == (not t or not any(c.isalpha() for c in t)) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    empty = docs(spark, EDGE).limit(0)
    assert langid.identify(empty).count() == 0
    nothing = langid.identify(docs(spark, EDGE).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_words_alone_and_together_agree():
    net = langid.Network(["de", "en"])
    texts = ["ab cd ab", "cd", "ab cd " * 50]
    one = [langid.predict(net, [t]) for t in texts]
    names, scores = langid.predict(net, texts)
    assert names == [n[0] for n, _ in one] and scores == pytest.approx([s[0] for _, s in one])


def test_every_language_is_learned(spark):
    df = spark.createDataFrame([(8 * i + j, f"words of {i}", f"l{i:02}") for i in range(70) for j in range(8)], "doc_id long, text string, lang string")
    assert langid.train(df, "doc_id", "text", "lang", 2).langs == [f"l{i:02}" for i in range(70)]


def test_held_out_accuracy(spark):
    rows = langid.query(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.col("lang").alias("truth")), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.truth for r in rows]) >= 0.95


# links, languages and page frames that were lost


def _varied(n, gone):
    """n words, of which the ones at the given places are others."""
    return " ".join(f"w{i}" + "x" * (i in gone) for i in range(n))


@pytest.mark.parametrize("between", [None, 9])
def test_jaccard_links_run_through_rows_without_an_id(spark, between):
    a, mid, b = _varied(120, ()), _varied(120, (30, 50)), _varied(120, (30, 50, 80, 100))
    rows = [(1, a), (between, mid), (2, b), (None, mid), (None, "this row has neither an id nor a link at all"), (None, None)]
    sets_ = [shingle.shingles(t) for t in (a, mid, b)]
    share = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert share(sets_[0], sets_[1]) >= 0.75 and share(sets_[1], sets_[2]) >= 0.75 and share(sets_[0], sets_[2]) < 0.75
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {1: 1, 2: 1} | ({9: 1} if between else {})
    assert [r.component_id for r in got if r.doc_id is None] == [None] * (3 + (between is None)) and len(got) == 6


def test_jaccard_finds_classes_without_an_id_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rows = [(1, _varied(120, ())), (None, _varied(120, (30, 50))), (2, _varied(120, (30, 50, 80, 100)))] + [(None, _varied(120, (30, 50)))] * 20
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, None: None} and len(got) == 23


@pytest.mark.parametrize("ids", ["one", "pairs"])
def test_languages_of_repeated_ids_are_learned(spark, ids):
    """A third of all rows has one id, or is one row again and again; its language is learned all the same."""
    english, french = "the house on the hill was built with stone", "la maison que nous avons vue était en pierre"
    key = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(key, f"{french} {i if ids == 'one' else ''}", "fr") for i in range(5000)] + [(i, f"{english} {i}", "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    net = langid.train(df, "doc_id", "text", "lang", 2)
    assert net.langs == ["en", "fr"]
    assert langid.predict(net, [english, french])[0] == ["en", "fr"]


PROSE = "The river rose in the night, and by morning the lower fields were under water. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body><div class="container right-sidebar"><h1>T</h1><p>{PROSE}</p><div class="sidebar"><ul><li>x</li></ul></div></div></body>', f"T\n\n{PROSE.strip()}"),
        (f'<body><form action="/"><div><p>{PROSE}</p></div><input name="q"></form></body>', PROSE.strip()),
        (f'<body><div class="sidebar-left">{PROSE}</div></body>', PROSE.strip()),
        (f'<article><p>{PROSE}</p><table><tr><td class="share">45 %</td></tr></table><h2 class="banner">H</h2><p>is <span class="notice">important</span> here</p><div class="share">Share</div></article>', f"{PROSE.strip()}\n\n45 %\n\nH\n\nis important here"),
        ("<body><nav><ul><li>a</li></ul></nav><form><label>Search</label><input></form></body>", ""),
        (f'<body><div class="cookie-notice"><p>{PROSE}</p></div></body>', ""),
        (f'<body><p>Short article here.</p><div class="comments"><p>{PROSE}</p></div></body>', "Short article here."),
        (f'<body><p>{PROSE}</p><div class="sidebar"><p>{PROSE[:100]}</p></div><form><p>Write to us</p></form></body>', PROSE.strip()),
        (f'<body><div class="nav menu"><ul><li>{PROSE}</li></ul></div><p>Text.</p></body>', "Text."),
    ],
)
def test_class_words_alone_delete_no_frame(page, want):
    assert htmltext.extract(page) == want


# 8: templates


def plain_pages(rows):
    """The template rule with plain sets: rows (id, host, html); returns the texts, and those without any template."""
    pages = [(k, host, htmltext.Page(page)) for k, host, page in rows]
    seen, own, hosts = {}, {}, {}
    for k, host, p in pages:
        for t in p.trees if host else ():
            if t[1]:
                hosts.setdefault(t[0], set()).add(host)
        inside = [i for i, b in enumerate(p.blocks) if b[1]]
        flat, n = htmltext.keys([p.blocks[i][0] for i in inside])
        own[k] = dict(zip(inside, np.split(flat, np.cumsum(n)[:-1]) if inside else [], strict=True))
        for h in {t[0] for t in p.trees} | {int(x) for xs in own[k].values() for x in xs}:
            seen.setdefault((host, h), set()).add(p.main)
    often = {x for x, mains in seen.items() if x[0] and len(mains) >= htmltext.LEAST_PAGES}
    said = {}
    for k, host, p in pages:
        hit = [t for t in p.trees if (host, t[0]) in often]
        gone = {i for t in hit for i in range(t[2], t[3])}
        variant = {i for i, xs in own[k].items() if sum((host, int(x)) in often for x in xs) >= htmltext.VARIANT}
        mine = sum(len(p.blocks[i][0]) for i in p.take if i not in gone and i not in variant)
        speaks = 0 < mine >= htmltext.OWN * sum(len(p.blocks[i][0]) for i in p.take)
        for t in hit:
            said.setdefault((host, t[0], t[1]), set()).add((speaks, p.main))
    template = set()
    for (host, h, inside), who in said.items():
        n = sum(speaks for speaks, _ in who)
        if not inside or (n >= htmltext.LEAST_PAGES and 2 * n >= len(who) and len(hosts[h]) < htmltext.HOSTS):
            template.add((host, h))
    out, bare = {}, {}
    for k, host, p in pages:
        gone = {i for t in p.trees if (host, t[0]) in template for i in range(t[2], t[3])}
        out[k], bare[k] = ("\n\n".join(p.blocks[i][0] for i in p.take if i not in cut) for cut in (gone, ()))
    return out, bare


def test_templates_equal_plain_rule(spark):
    """Sites whose blocks have no marks: what recurs goes, also inside articles; near copies of one article keep their prose."""
    import random

    r = random.Random(88)
    words = [f"{a}{b}" for a in "ba de fi go lu ma ne po ri su".split() for b in "lan mer nos tik vor".split()]
    prose = lambda n: " ".join(r.choices(words, k=n)).capitalize() + "."
    rows, common = [], prose(12)
    for s in range(6):
        box, hint, offer, base = prose(14), prose(9), prose(25), [prose(30) for _ in range(4)]
        for i in range(r.randrange(4, 16)):
            own = [prose(r.randrange(5, 40)) for _ in range(r.randrange(1, 4))]
            if s == 1:  # near copies
                own = [x.replace(" ", f" {r.choice(words)} ", 1) if j == i % 4 else x for j, x in enumerate(base)]
            inner = [f"<p>{x}</p>" for x in own]
            for extra, chance in ((hint, 0.8), (offer, 0.3), (common, 0.7)):
                if r.random() < chance:
                    inner.insert(r.randrange(len(inner) + 1), f"<p>{extra}</p>" if extra == common else f"<div class=x{s}><p>{extra}</p></div>")
            body = "".join(inner) if s == 2 else f"<article>{''.join(inner)}</article>"
            html_ = f"<html><body><div class=top><p>{box}</p></div>{body}<div><p>{box}</p></div></body></html>"
            rows += [(len(rows), f"http://s{s}.example/{i}", html_)] * (2 if r.random() < 0.2 else 1)
    rows = [(k, url, h) for k, (_, url, h) in enumerate(rows)] + [(9000, None, rows[0][2]), (9001, "http://s9.example/", None)]
    want, bare = plain_pages([(k, re.search("//([^/]*)", url)[1] if url else "", h) for k, url, h in rows])
    got = {x.page_id: x.text for x in htmltext.texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want
    changed = [k for k in want if want[k] != bare[k]]
    assert len(changed) > 20 and all(want[k] == bare[k] for k, url, _ in rows if url and "s1." in url)
    assert any("article" in h for k, _, h in rows if k in changed)
    assert sum(common in x for x in want.values()) > 20 and all(common in want[k] for k, url, h in rows if url and h and common in h and "s2." not in url)


# 6: reputation


def plain_reputation(pages, outcomes):
    """Rates and lower bounds of hosts, by loops over levels: host, last two labels, last label."""
    n, b = Counter(), Counter()
    hosts = {h for _, h in pages}
    for i, h in pages:
        for j, bad in outcomes:
            if i == j:
                n[h] += 1
                b[h] += bad
    level = {"host": lambda h: h, "domain": lambda h: ".".join(h.split(".")[-2:]), "suffix": lambda h: h.split(".")[-1]}
    total_n, total_b = sum(n.values()), sum(b.values())
    p0 = (total_b + 1) / (total_n + 2)
    sums, strength = {}, {}
    for name, of in level.items():
        ns, bs = Counter(), Counter()
        for h in hosts:
            ns[of(h)] += n[h]
            bs[of(h)] += b[h]
        sums[name] = ns, bs
        used = [(ns[g], bs[g]) for g in ns if ns[g]]
        p = total_b / total_n
        spread = sum(y * y / x for x, y in used) - total_b * p
        one, room = p * (1 - p), total_n - sum(x * x for x, _ in used) / total_n - (len(used) - 1)
        rho = (spread / one - (len(used) - 1)) / room if one > 0 and room > 0 else 0.0
        rho = max(min(rho, 1 / (1 + urls.LEAST)), 1 / (1 + urls.MOST))
        strength[name] = (1 - rho) / rho
    out = {}
    for h in hosts:
        (sn, sb), (dn, db) = ((sums[x][0][level[x](h)], sums[x][1][level[x](h)]) for x in ("suffix", "domain"))
        ms = (sb + strength["suffix"] * p0) / (sn + strength["suffix"])
        md = (db + strength["domain"] * ms) / (dn + strength["domain"])
        alpha, beta = b[h] + strength["host"] * md, n[h] - b[h] + strength["host"] * (1 - md)
        rate = alpha / (alpha + beta)
        out[h] = n[h], b[h], rate, rate - urls.Z * (rate * (1 - rate) / (alpha + beta + 1)) ** 0.5
    return out


def test_reputation_equals_plain_levels(spark):
    """Sites good and bad; repeated pages and outcomes count again; a new host below a bad domain inherits its rate and is blocked."""
    import random

    r = random.Random(61)
    rate = {"good.org": 0.02, "mixed.org": 0.4, "bad.biz": 0.97, "worse.biz": 0.99, "fine.net": 0.0}
    pages, outcomes = [], []
    for i in range(900):
        domain = r.choice(list(rate))
        pages.append((i, f"h{r.randrange(4)}.{domain}"))
        if r.random() < 0.8:
            outcomes.append((i, r.random() < rate[domain]))
    pages += [(9000, "new.bad.biz"), (9001, "new.good.org"), (9002, "alone.xyz"), *pages[:40]]
    outcomes += outcomes[:25]
    got = {x.host: x for x in urls.reputation(spark.createDataFrame(pages, "id long, host string"), spark.createDataFrame(outcomes, "id long, bad boolean")).collect()}
    want = plain_reputation(pages, outcomes)
    assert set(got) == set(want)
    for h, (n, bad, mean, low) in want.items():
        assert (got[h].n_labelled, got[h].n_bad) == (n, bad) and abs(got[h].rate - mean) < 1e-9 and abs(got[h].low - low) < 1e-9
    assert got["new.bad.biz"].low > urls.LIMIT > got["new.good.org"].rate and got["h0.bad.biz"].low > urls.LIMIT
    page = spark.createDataFrame([(i, f"http://{h}/x") for i, h in pages], "page_id long, url string")
    verdicts = {x.host: x.verdict for x in urls.filtered(page, spark.createDataFrame(outcomes, "id long, bad boolean")).collect()}
    assert {h for h, v in verdicts.items() if v == "block"} == {h for h, x in want.items() if x[3] > urls.LIMIT} and "new.bad.biz" in {h for h, v in verdicts.items() if v == "block"}


# 9: equal rows


def test_equal_rows_are_numbered_apart(spark, monkeypatch):
    """Half of all rows are one row; null keys; the number's range of a content doesn't depend on the partitions."""
    monkeypatch.setattr(sharding, "BUCKET", 50)
    rows = [(1, "same")] * 300 + [(None, "no key")] * 40 + [(i, f"t{i % 50}") for i in range(250)] + [(None, None)] * 9
    seen = []
    for parts in 1, 7:
        got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted(r.row for r in got) == list(range(len(rows)))
        assert all((r.shard, r.slot) == (int(p) % 16, int(p) // 16) for r, p in zip(got, sharding.Permutation(len(rows)).forth(np.array([r.row for r in got])), strict=True))
        seen.append(sorted((str(r.doc_id), r["size"], r.text_crc32, r.row) for r in got))
    assert seen[0] == seen[1]
    count = Counter(r.shard for r in got)
    assert max(count.values()) - min(count.values()) <= 1 and len(count) == 16
