"""Utterance capture with hysteresis: onset above a limit, end after quiet blocks below a lower limit.

An attempt that hears no onset in `wait` blocks gives up: its blocks are returned with hit_max null. The next one begins
with the block behind it, and its pre-roll doesn't reach back before that. Without `wait` no attempt gives up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


class Capture:
    """Takes levels block by block; `step` returns (first, last, hit_max) of a captured utterance, or of an attempt that gave up (hit_max None), or None."""

    def __init__(self, onset: float = 40.0, drop: float = 3.0, quiet: int = 3, pre: int = 3, tail: int = 2, most: int = 40, wait: int | None = None):
        self.onset, self.end, self.quiet, self.pre, self.tail, self.most, self.wait = onset, onset - drop, quiet, pre, tail, most, wait
        self.at, self.first, self.voiced, self.silent, self.free, self.waited = -1, None, 0, 0, 0, 0

    def step(self, db: float):
        self.at += 1
        if self.first is None:
            self.waited += 1
            if db > self.onset:
                self.first, self.voiced, self.silent, self.waited = max(self.free, self.at - self.pre), self.at, 0, 0
            elif self.wait is not None and self.waited >= self.wait:
                self.free, self.waited = self.at + 1, 0
                return (self.at - self.wait + 1, self.at, None)
            return None
        if db >= self.end:
            self.voiced, self.silent = self.at, 0
        else:
            self.silent += 1
        full = self.at - self.first + 1 >= self.most
        if self.silent >= self.quiet or full:
            out = (self.first, min(self.at, self.voiced + self.tail), full and self.silent < self.quiet)
            self.first, self.free = None, self.at + 1
            return out
        return None


def captures(levels: DataFrame, **how) -> DataFrame:
    """(stream_id, first_hop, last_hop, hit_max) of rows (stream_id, hop, db)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, out = Capture(**how), []
        for pdf in batches:
            out += [x for x in map(c.step, pdf["db"]) if x]
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "first_hop": [x[0] for x in out], "last_hop": [x[1] for x in out], "hit_max": pd.array([x[2] for x in out], dtype="boolean")})

    run.__annotations__ = {"key": tuple, "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    rows = levels.select("stream_id", "hop", "db").repartition("stream_id").sortWithinPartitions("stream_id", "hop")
    return rows.groupBy("stream_id").applyInPandas(run, "stream_id long, first_hop long, last_hop long, hit_max boolean")
