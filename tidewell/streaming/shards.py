"""Many small states in one group: keys are dealt to a fixed number of shards, each a group whose state holds its keys.

Handing a group to Python costs some milliseconds a micro-batch, far more than the rows of a channel; a shard pays that once
for all its channels. The number of shards belongs to a stream's checkpoint. A shard's rows of a micro-batch and its states
are held by a task.

Nulls: a null key has a shard of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 1024
#: What the state of a shard is: its keys with what is known of them, as JSON.
STATE = "known string"


def shard(key: Column) -> Column:
    return F.when(key.isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(SHARDS))).cast("int").alias("shard")


def known(state) -> dict:
    return {k: v for k, v in json.loads(state.get[0])} if state.exists else {}


def keep(state, known: dict) -> None:
    state.update((json.dumps(list(known.items())),))


def rows(shard: tuple, batches: Iterable[pd.DataFrame], key: str, columns: list[str]) -> dict[object, list[tuple]]:
    """The rows of each key, as tuples of the columns."""
    out: dict[object, list[tuple]] = {}
    for b in batches:
        for k, *x in zip(*(b[c].tolist() for c in (key, *columns)), strict=True):
            out.setdefault(None if shard[0] < 0 else k, []).append(tuple(x))
    return out
