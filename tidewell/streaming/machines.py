"""State machines of one stream each as stateful streams: the two-state machine, and capture with hysteresis.

The machines are those of the batch operators. Their whole state is a handful of
numbers, kept as JSON by shards of streams between micro-batches. Rows of a micro-batch are taken in
order of `hop`; a row that comes too late (its hop was passed) is left out, so a
stream that is replayed gives the same result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidewell.operators.sessions import Machine
from tidewell.streaming import shards
from tidewell.streaming.capture import Capture


def _stateful(rows: DataFrame, make, columns: list[str], take, schema: str) -> DataFrame:
    """take(machine, hop, *values of the columns) gives output rows without the stream's id; the machine's attributes are the state."""
    names = ["stream_id", *[c.split()[0] for c in schema.split(", ")]]

    def step(shard, batches, state):
        known, out = shards.known(state), []
        for stream, fresh in shards.rows(shard, batches, "stream_id", ["hop", *columns]).items():
            machine, at = make(), -1
            if stream in known:
                at, kept = known[stream]
                machine.__dict__.update(kept)
            for hop, *values in sorted(fresh, key=lambda x: x[0]):
                if hop > at:
                    at = int(hop)
                    out += [(stream, *x) for x in take(machine, at, *values)]
            known[stream] = (at, machine.__dict__)
        shards.keep(state, known)
        if out:
            yield pd.DataFrame(out, columns=names)

    own = rows.where("hop IS NOT NULL").select("stream_id", shards.shard(F.col("stream_id")), "hop", *columns)
    return own.groupBy("shard").applyInPandasWithState(step, f"stream_id long, {schema}", shards.STATE, "append", GroupStateTimeout.NoTimeout)


def utterance_marks(levels: DataFrame, **policy) -> DataFrame:
    """Streaming (stream_id, what, hop, prob): wakes and ends of the two-state machine over (stream_id, hop, prob, level)."""

    def take(m: Machine, hop: int, prob: float, level: float):
        what = m.step(prob, level)
        return [(what, hop, prob)] if what else []

    return _stateful(levels, lambda: Machine(**policy), ["prob", "level"], take, "what string, hop long, prob double")


def captured(levels: DataFrame, **how) -> DataFrame:
    """Streaming (stream_id, first_hop, last_hop, hit_max) over (stream_id, hop, db)."""

    def take(c: Capture, hop: int, db: float):
        got = c.step(db)
        return [(int(got[0]), int(got[1]), None if got[2] is None else bool(got[2]))] if got else []

    return _stateful(levels, lambda: Capture(**how), ["db"], take, "first_hop long, last_hop long, hit_max boolean")
