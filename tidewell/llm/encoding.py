"""Token ids of the given tokenizer files, by the tokenizers library.

A byte-level BPE of this kind cuts texts into pretokens before it merges. A
space that a character other than white space follows always begins a new
pretoken, whatever stands before it; so a text may be cut there, and its ids
are those of the parts in turn. `Pieces` keeps the ids of parts it has seen, in
a table of bounded size. Texts that hold a special token's string are encoded
as a whole.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

from tidewell.llm.common import kept

#: Parts that one Python worker remembers, and characters of a part that is remembered.
REMEMBERED, LONGEST = 300_000, 64
#: Characters that are encoded at once.
BLOCK = 500_000


def tokenizer(path: str):
    """The tokenizer of a file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def specials(tok) -> list[str]:
    """Strings of a tokenizer's added tokens."""
    return [t.content for t in tok.get_added_tokens_decoder().values()]


_OTHER = re.compile(r"[^\x00-\u024f]")
_LOOSE = re.compile(r" (?:\s|[\x00-\x20]|$)|\x00")


def parts_of(text: str) -> list[str]:
    """The text cut before every space that a character other than white space follows."""
    if not _LOOSE.search(text):
        out = text.replace(" ", "\x00 ").split("\x00")
        return out if out[0] else out[1:]
    head, *rest = text.split(" ")
    out = [head]
    for w in rest:
        if w and w[0] > " " and not w[0].isspace():
            out.append(" " + w)
        else:
            out[-1] += " " + w
    return out if out[0] else out[1:]


class Pieces:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, from the remembered ids of their parts.

    Parts that aren't remembered yet and hold Latin characters alone are
    joined and encoded at once by the rank file of the same vocabulary, where
    there is one beside the tokenizer file (a test holds both to the same
    ids); any other part is encoded by the tokenizer file.
    """

    def __init__(self, path: str):
        self.tok, self.seen, self.ranks = tokenizer(path), {}, None
        self.special = specials(self.tok)
        beside = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(beside):
            import public_tokenizers
            import tiktoken

            with open(beside, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.width = np.zeros(max(ranks.values()) + 1, np.int64)
            for k, v in ranks.items():
                self.width[v] = len(k)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def fresh(self, parts: set[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        if self.ranks is not None:
            joined = [w for w in parts if w[0] == " " and not _OTHER.search(w)]
            ids = np.array(self.ranks.encode_ordinary("".join(joined)), "<u4")
            ends = np.cumsum([len(w.encode()) for w in joined])
            at = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1 if joined else []
            raw, last = ids.tobytes(), 0
            for w, i in zip(joined, at, strict=True):
                out[w] = raw[4 * last : 4 * i]
                last = i
        for w in parts:
            if w not in out:
                out[w] = self.whole(w)
        return out

    def encode_block(self, texts: list[str]) -> list[bytes]:
        cut = [None if any(s in t for s in self.special) else parts_of(t) for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        missing: set[str] = set()
        for ws in cut:
            missing.update(() if ws is None else ws)
        missing.difference_update(seen)
        seen.update(self.fresh(missing))
        out = [self.whole(t) if ws is None else b"".join(map(seen.__getitem__, ws)) for t, ws in zip(texts, cut, strict=True)]
        for w in missing:
            if len(w) > LONGEST:
                del seen[w]
        return out

    def encode(self, texts):
        """The ids' bytes of each text (None counts as empty), in blocks of bounded size."""
        block, size = [], 0
        for t in texts:
            block.append(t or "")
            size += len(block[-1])
            if size >= BLOCK:
                yield from self.encode_block(block)
                block, size = [], 0
        yield from self.encode_block(block)


def pieces(path: str) -> Pieces:
    return kept(f"pieces {path}", lambda: Pieces(path))
