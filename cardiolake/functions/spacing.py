"""Greedy selection with a least spacing, without a list of a whole key.

Taking the best first and dropping what is too close to it is the same as this: a point is
taken if every better one that is too close is dropped, and dropped if one that is too
close is taken.  Each task decides what it can in one stretch of the line, with the points
of one spacing around it; what still waits for points of other stretches is decided in the
next round, in which stretches are twice as wide.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import by_group, written

UNKNOWN, TAKEN, DROPPED = 0, 1, 2


def decide(pos: np.ndarray, rank: np.ndarray, status: np.ndarray, own: np.ndarray, spacing: float) -> np.ndarray:
    """Status of points sorted by place; ``rank``: 0 is the best.  Only ``own`` points are decided."""
    status, wide = status.copy(), spacing * (1 + 1e-9)
    low, high = np.searchsorted(pos, pos - wide), np.searchsorted(pos, pos + wide, side="right")
    for i in np.argsort(rank, kind="stable"):
        if not own[i] or status[i] != UNKNOWN:
            continue
        near = slice(low[i], high[i])
        close = np.abs(pos[near] - pos[i]) < spacing
        if (close & (status[near] == TAKEN)).any():
            status[i] = DROPPED
        elif not (close & (status[near] == UNKNOWN) & (rank[near] < rank[i])).any():
            status[i] = TAKEN
    return status


def spread(points: DataFrame, group: Sequence[str], width: float) -> DataFrame:
    """The points (group, pos, height, tie, spacing) that are taken, the highest first, of
    equals the one of smaller ``tie``; pairs closer than ``spacing`` exclude each other.

    ``width``: the stretches of the first round.
    """
    state = points.withColumn("status", F.lit(UNKNOWN))
    schema = state.schema

    def settle(rows: pa.Table) -> pa.Table:
        column = lambda c: rows.column(c).to_numpy()
        rank = np.empty(rows.num_rows, dtype=np.int64)
        rank[np.lexsort((column("tie"), -column("height")))] = np.arange(rows.num_rows)
        own = column("own")
        status = decide(column("pos"), rank, column("status"), own, column("spacing")[0]).astype(np.int32)
        settled = rows.set_column(rows.column_names.index("status"), "status", pa.array(status))
        return settled.filter(pa.array(own & (status != DROPPED)))

    while True:
        at = lambda x: F.floor(x / width)
        stretches = F.sequence(at(F.col("pos") - F.col("spacing")), at(F.col("pos") + F.col("spacing")))
        seen = state.withColumn("t", F.explode(stretches)).withColumn("own", at(F.col("pos")) == F.col("t"))
        width *= 2
        state = written(by_group(seen, [*group, "t"], ["pos"], settle, schema))
        if not state.where(F.col("status") == UNKNOWN).limit(1).count():
            return state.where(F.col("status") == TAKEN).drop("status")
