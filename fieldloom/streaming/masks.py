"""Mask changes of arriving steps with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldloom import SENTINEL

STEP = "var string, t int, bucket bigint, vid bigint, val float"
OUTPUT = "var string, vid bigint, t int, late boolean"
STATE = "seen binary, mask binary"
BUCKET = 4096
"""Vertex ids per state key: bounds the state and the rows of one key and step."""


def stream_mask_events(steps: DataFrame, batch: int, bucket: int = BUCKET) -> DataFrame:
    """(var, vid, t, late): mask flips at refresh steps, and beside them the samples that came late.

    ``steps`` has (var, t, vid, val). The state of a (variable, id bucket) is one bit and the last
    refresh step per vertex, so a restart from the checkpoint goes on where the stream stopped,
    and a step may arrive in pieces. What arrives in one trigger is taken in the order of its
    steps. A sample whose vertex has had that step or a later one changes nothing and is a row
    with ``late`` true, also where a sample comes twice; no step ends the stream. A null value
    counts as present, rows without vertex, variable or step take no part. A sink partitioned by
    ``late`` keeps both tables apart. A key holds seven bytes a sample of its backlog.
    """
    refresh = steps.where((F.col("t") % batch == 0) & F.col("vid").isNotNull() & F.col("var").isNotNull())
    keyed = refresh.withColumn("bucket", F.floor(F.col("vid") / bucket).cast("bigint"))

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        var, number = key
        seen, mask = np.full(bucket, -1, np.int32), np.zeros(bucket, bool)
        if state.exists:
            last, packed = state.get
            seen = np.frombuffer(last, np.int32).copy()
            mask = np.unpackbits(np.frombuffer(packed, np.uint8))[:bucket].astype(bool)
        parts = [
            (f.t.to_numpy(np.int32), (f.vid.to_numpy() - number * bucket).astype(np.uint16), f.val.to_numpy() == np.float32(SENTINEL)) for f in frames
        ]
        t, at, gone = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((at, t))  # stable: repeated samples keep their order of arrival
        t, at, gone = t[order], at[order], gone[order]
        cuts = np.flatnonzero(np.diff(t)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(t)]):
            step, here = t[lo], at[lo:hi]
            first = np.concatenate([[True], here[1:] != here[:-1]])
            late = ~first | (seen[here] >= step)
            flips = ~late & (mask[here] != gone[lo:hi])
            mask[here[~late]], seen[here[~late]] = gone[lo:hi][~late], step
            told = late | flips
            if told.any():
                vid = here[told].astype(np.int64) + number * bucket
                yield pd.DataFrame({"var": var, "vid": vid, "t": step, "late": late[told]})
        state.update((seen.tobytes(), np.packbits(mask).tobytes()))

    events = keyed.groupBy("var", "bucket").applyInPandasWithState(
        update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
    # computed, so that partitioned sinks get rows of their own and not views of Arrow batches
    return events.select("var", "vid", "t", F.coalesce("late", F.lit(False)).alias("late"))


def stream_mask_changes(steps: DataFrame, batch: int, bucket: int = BUCKET) -> DataFrame:
    """(var, vid, t) where the mask flips at a refresh step; late samples are left out."""
    return stream_mask_events(steps, batch, bucket).where("not late").select("var", "vid", "t")
