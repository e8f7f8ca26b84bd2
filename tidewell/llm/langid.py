"""Operator 10: language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a segment from both ends; at every byte
position it gives probabilities of the languages from both hidden states. It is
trained in numpy by backpropagation through time. Segments are words with the
spaces that bound them: the state starts anew at each word, so a word's
positions get the same labels wherever it stands, and a Python worker computes
every distinct word of a block once. A document pools the log probabilities of
all positions of all its words (whole text) into its probabilities; words
without a letter say nothing.

The context of a position is so its word (of text without spaces, a segment of
up to SEGMENT bytes, cut between characters). That gives up what word order says
and makes the work that of a corpus's distinct words.

Learning: from a bounded sample, ROWS_PER_LANG rows at most of each language
(those of the least hashes of id and text among the labelled rows of the training
folds; equal rows count once), and of each row WORDS_PER_ROW words at most, spread
evenly over its whole text. Every language with labelled rows is learned: where
rows repeat so that too few differ among the least hashes, the share of hashes
that is looked at is widened. The network goes to
the executors as a few kilobytes of weights.

Nulls: rows with a null language aren't learned from; a null text, or one
without a letter, is `und` with score 0, as is every text if nothing could be
learned. Repeated rows are predicted row by row. Empty tables give no rows.
Extra columns are ignored; language, source and id are no inputs of a prediction.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import kept, table

#: Labelled rows of each language, and words of each, that are learned from.
ROWS_PER_LANG, WORDS_PER_ROW = 300, 250
#: Size of a byte's embedding and of each direction's state; longest segment in bytes (longer words are cut); steps, words of a step, rate, seed.
EMBED, HIDDEN, SEGMENT, STEPS, BATCH, RATE, SEED = 12, 16, 48, 500, 256, 0.01, 7
#: A document's log odds are the mean over its positions times this, at most the number of positions.
EVIDENCE = 20.0

_SPEAKS = re.compile(rb"[A-Za-z\x80-\xff]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def encode(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes 1..256 (0: padding) of the words with a space on both sides, and their lengths."""
    codes = np.zeros((len(words), width), np.int16)
    size = np.array([len(w) + 2 for w in words])
    flat = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8)
    row = np.repeat(np.arange(len(words)), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    codes[row, col] = flat.astype(np.int16) + 1
    return codes, size


class Network:
    """Weights: E (bytes x embed); for each direction W (embed x 3H), U (H x 3H), b (3H); V (2H x langs), c (langs)."""

    def __init__(self, langs: list[str], seed: int = SEED, embed: int = EMBED, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": (r.standard_normal((257, embed)) * 0.3).astype(np.float32), "V": g(2 * hidden, len(langs)), "c": np.zeros(len(langs), np.float32)}
        for d in "fb":
            self.p |= {"W" + d: g(embed, 3 * hidden), "U" + d: g(hidden, 3 * hidden), "b" + d: np.zeros(3 * hidden, np.float32)}

    def _run(self, d: str, x: np.ndarray, live: np.ndarray, keep: bool):
        """States after each step, the padding keeping the state; what backpropagation needs."""
        h = self.h
        p = self.p
        pre = (p["E"] @ p["W" + d] + p["b" + d])[x]  # of a byte's code: one row
        state, out, tape = np.zeros((x.shape[0], h), np.float32), np.empty((*x.shape, h), np.float32), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            u = state @ p["U" + d]
            zr = _sigmoid(pre[:, t, : 2 * h] + u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(pre[:, t, 2 * h :] + r * u[:, 2 * h :])
            new = np.where(live[:, t, None], z * state + (1 - z) * n, state)
            if keep:
                tape.append((t, state, z, r, n, u[:, 2 * h :]))
            state = new
            out[:, t] = state
        return out, tape

    def log_probs(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log probabilities of the languages at every position (words x positions x langs)."""
        live = np.arange(x.shape[1]) < size[:, None]
        s = np.concatenate([self._run("f", x, live, False)[0], self._run("b", x, live, False)[0]], axis=2) @ self.p["V"] + self.p["c"]
        s -= s.max(axis=2, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=2, keepdims=True))

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """Sums over the words' positions of the log probabilities, computed in blocks of words of like length."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        for at in range(0, len(order), 4096):
            o = order[at : at + 4096]
            block = [words[i] for i in o]
            x, size = encode(block, len(block[-1]) + 2)
            lp = self.log_probs(x, size)
            out[o] = (lp * (np.arange(x.shape[1]) < size[:, None])[:, :, None]).sum(axis=1)
        return out

    def gradients(self, x: np.ndarray, size: np.ndarray, y: np.ndarray):
        """Loss (mean cross entropy over all positions) and its gradients, by backpropagation through time."""
        h, p = self.h, self.p
        live = np.arange(x.shape[1]) < size[:, None]
        runs = {d: self._run(d, x, live, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        s = both @ p["V"] + p["c"]
        s -= s.max(axis=2, keepdims=True)
        q = np.exp(s)
        q /= q.sum(axis=2, keepdims=True)
        total = live.sum()
        one = np.eye(len(self.langs), dtype=np.float32)[y]
        loss = -(np.log(np.maximum(q[np.arange(len(y)), :, y], 1e-9)) * live).sum() / total
        ds = ((q - one[:, None, :]) * live[:, :, None] / total).astype(np.float32)
        g = {"V": np.einsum("nth,ntl->hl", both, ds), "c": ds.sum(axis=(0, 1)), "E": np.zeros_like(p["E"])}
        dboth = ds @ p["V"].T
        for d, cols in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            U = p["U" + d]
            dpre = np.zeros((*x.shape, 3 * h), np.float32)
            dU = np.zeros_like(U)
            carry = np.zeros((x.shape[0], h), np.float32)
            for t, prev, z, r, n, un in reversed(runs[d][1]):
                dh = dboth[:, t, cols] + carry
                on = live[:, t, None]
                dn = dh * (1 - z) * (1 - n * n) * on
                dz = dh * (prev - n) * z * (1 - z) * on
                dr = dn * un * r * (1 - r)
                dpre[:, t] = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                dU += prev.T @ du
                carry = np.where(on, dh * z, dh) + du @ U.T
            flat = dpre.reshape(-1, 3 * h)
            table_ = np.zeros((257, 3 * h), np.float32)
            np.add.at(table_, x.ravel(), flat)
            g["W" + d], g["U" + d], g["b" + d] = p["E"].T @ table_, dU, flat.sum(axis=0)
            g["E"] += table_ @ p["W" + d].T
        return loss, g

    def fit(self, words: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> float:
        """Adam over batches drawn evenly from the languages; returns the last batches' mean loss."""
        r = np.random.default_rng(seed)
        of = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            pick = np.concatenate([r.choice(o, max(1, batch // len(of))) for o in of])
            block = [words[i] for i in pick]
            x, size = encode(block, max(map(len, block)) + 2)
            loss, g = self.gradients(x, size, y[pick])
            losses.append(loss)
            now = rate * min(1, 2 * (1 - (step - 1) / steps))
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.002 * (d * d - v[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))


def words_of(text: str) -> list[bytes]:
    """Segments of a whole text: its words, longer ones in parts that end between characters."""
    out = []
    for w in text.encode("utf-8", "surrogatepass").split():
        if len(w) <= SEGMENT:
            out.append(w)
            continue
        at = 0
        while at < len(w):
            end = min(len(w), at + SEGMENT)
            while end < len(w) and w[end] & 0xC0 == 0x80 and end > at + SEGMENT - 4:
                end -= 1
            out.append(w[at:end])
            at = end
    return out


def fold_of(key: Column) -> Column:
    """Fold 0..3 of a row: crc32 of its id as text, mod 4."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def train(docs: DataFrame, key: str, text: str, lang: str, held_out: int, rows: int = ROWS_PER_LANG, words_per_row: int = WORDS_PER_ROW) -> Network | None:
    """A network from a bounded sample of the labelled rows that aren't held out."""
    own = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & (fold_of(F.col(key)) != held_out))
    own = own.select(F.col(lang).alias("l"), F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(SEED)), F.lit(1 << 40)).alias("s"), F.col(text).alias("t"))
    counts = {r[0]: r[1] for r in own.groupBy("l").count().collect()}  # one row a language
    if not counts:
        return None
    share = {name: min(1.0, (2 * rows + 40) / n) for name, n in counts.items()}
    while True:  # hashes below the share that gives twice the rows of the language; of those, the least
        limits = docs.sparkSession.createDataFrame([(name, int((1 << 40) * x)) for name, x in share.items()], "l string, below long")
        least = own.join(F.broadcast(limits.withColumn("l", F.col("l").cast(own.schema["l"].dataType))), "l").where("s < below")
        if all(x == 1 for x in share.values()):
            break
        got = {r[0]: r[1] for r in least.select("l", "s").distinct().groupBy("l").count().collect()}
        short = [name for name, x in share.items() if x < 1 and got.get(name, 0) < rows]
        if not short:
            break
        share |= {name: min(1.0, 8 * share[name]) for name in short}
    picked = least.select("l", "s", "t").dropDuplicates(["l", "s"])
    picked = picked.withColumn("i", F.row_number().over(Window.partitionBy("l").orderBy("s"))).where(F.col("i") <= rows)

    def spread(batches):
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                ws = [w for w in words_of(t) if _SPEAKS.search(w)]
                n = min(len(ws), words_per_row)
                out.append([ws[i * len(ws) // n] for i in range(n)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.binary()))], names=["l", "s", "w"])

    got = sorted(picked.select("l", "s", "t").mapInArrow(spread, "l string, s long, w array<binary>").collect(), key=lambda r: (r["l"], r["s"], r["w"]))
    words, y = [], []
    for r in got:
        words += map(bytes, r["w"])
        y += [r["l"]] * len(r["w"])
    langs = sorted(set(y))
    if not langs:
        return None
    net = Network(langs)
    net.fit(words, np.searchsorted(langs, y))
    return net


#: Sums of words that a Python worker remembers, and characters of a block of texts.
REMEMBERED, BLOCK = 250_000, 1_000_000


def predict(net: Network | None, texts: list[str | None], known: dict | None = None) -> tuple[list[str], list[float]]:
    """The language of each whole text, and the pooled probability of it."""
    known = {} if known is None else known
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if net is None:
        return names, scores
    if len(known) > REMEMBERED:
        known.clear()
    split = [words_of(t) if has_letter(t) else [] for t in texts]
    missing = set().union(*split).difference(known) if split else set()
    if missing:
        fresh = [w for w in missing if _SPEAKS.search(w)]
        known.update(dict.fromkeys(missing, bytes(4 * len(net.langs))))
        known.update(zip(fresh, map(bytes, net.pooled(fresh)), strict=True))
    for j, ws in enumerate(split):
        if not ws:
            continue
        total = np.frombuffer(b"".join(map(known.__getitem__, ws)), np.float32).reshape(len(ws), -1).sum(axis=0, dtype=np.float64)
        n = sum(map(len, ws)) + 2 * len(ws)
        s = total / n * min(EVIDENCE, n)
        q = np.exp(s - s.max())
        q /= q.sum()
        best = int(np.argmax(q))
        names[j], scores[j] = net.langs[best], float(q[best])
    return names, scores


def _predicted(docs: DataFrame, net: Network | None, text: str | None = None) -> DataFrame:
    """(k, lang_pred, score) of rows (k, t), or of rows (k) that are structs with the field `text`."""
    kind = docs.schema["k"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)
    mark = zlib.crc32(b"".join(net.p[k].tobytes() for k in sorted(net.p))) if net else 0

    def run(batches):
        known = kept(f"language sums {mark}", dict)
        for b in batches:
            names, scores, block, size = [], [], [], 0
            for t in (b.column(1) if text is None else b.column(0).field(text)).to_pylist():
                block.append(t)
                size += len(t or "")
                if size >= BLOCK:
                    got = predict(shared.value, block, known)
                    names, scores, block, size = names + got[0], scores + got[1], [], 0
            got = predict(shared.value, block, known)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names + got[0], pa.string()), pa.array(scores + got[1], pa.float64())], names=["k", "lang_pred", "score"])

    return docs.mapInArrow(run, f"k {kind}, lang_pred string, score double")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out: int = 2, net: Network | None = None) -> DataFrame:
    """Rows (key, held_out, lang_pred, score)."""
    net = net or train(docs, key, text, lang, held_out)
    out = _predicted(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), net)
    held = F.coalesce(fold_of(F.col("k")) == held_out, F.lit(False))
    return out.select(F.col("k").alias(key), held.alias("held_out"), "lang_pred", "score")


def annotate(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out: int = 2, net: Network | None = None) -> DataFrame:
    """Rows (row, lang_pred, score): the whole rows as structs, so that no column of theirs clashes."""
    net = net or train(docs, key, text, lang, held_out)
    return _predicted(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("k")), net, text).withColumnRenamed("k", "row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
