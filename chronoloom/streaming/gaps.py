"""Streaming counterparts: causal gaps per node, and the evaluation grid as it fills."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.timing import cell_index

GAPS = "row_id long, timestamp timestamp, node string, anomaly boolean, prev_anomaly boolean, gap_prev_s double, window_idx long"
_STATE = "first_us long, last_us long, last_anomaly boolean"


def stream_gaps(events: DataFrame, grid_s: float, watermark: str = "1 hour") -> DataFrame:
    """Gap to the event before, its label, and the grid cell of every event of a stream.

    State of a node is three values.  Events of one batch are put in order; one
    that is older than its node's last event gets a null gap, as the sequence it
    belonged to has already gone out.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["timestamp", "row_id"], kind="stable")
        first, last, anomaly = state.get if state.exists else (None, None, None)
        out = []
        for r in rows.itertuples():
            us = r.timestamp.value // 1000 if r.timestamp.unit == "ns" else int(r.timestamp.as_unit("us").value)
            first = us if first is None else first
            late = last is not None and us < last
            gap = None if last is None or late else (us - last) / 1e6
            out.append((r.row_id, r.timestamp, key[0], r.anomaly, None if late else anomaly, gap, int((us - first) / 1e6 // grid_s)))
            if not late:
                last, anomaly = us, bool(r.anomaly)
        state.update((first, last, anomaly))
        yield pd.DataFrame(out, columns=["row_id", "timestamp", "node", "anomaly", "prev_anomaly", "gap_prev_s", "window_idx"])

    slim = events.select("row_id", "timestamp", "node", "anomaly").withWatermark("timestamp", watermark)
    return slim.groupBy("node").applyInPandasWithState(step, GAPS, _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_cells(events: DataFrame, origins: DataFrame, grid_s: float, watermark: str = "1 hour") -> DataFrame:
    """Counts and truth of grid cells from known node origins (a static table), by update."""
    seconds = (F.unix_micros("timestamp") - F.unix_micros("origin")) / 1e6
    return (
        events.withWatermark("timestamp", watermark).join(origins, "node")
        .groupBy("node", cell_index(seconds, F.lit(float(grid_s))).alias("window_idx"))
        .agg(F.count("*").alias("n_events"), F.max("anomaly").alias("truth"))
    )
