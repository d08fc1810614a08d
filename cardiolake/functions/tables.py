"""Written tables in the folder that all executors share: lineage ends there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_path(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; on one machine without one, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table that was written and is read again."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _changes(batch: pa.RecordBatch, group: Sequence[str]) -> np.ndarray:
    """Rows at which another group begins (nulls are equal)."""
    differs = np.zeros(batch.num_rows, dtype=bool)
    for c in group:
        a, b = batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)
        unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        differs[1:] |= unlike | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(differs)


def by_group(df: DataFrame, group: Sequence[str], order: Sequence[str], fn: Callable[[pa.Table], pa.Table | None], schema: str | StructType) -> DataFrame:
    """``fn`` of every group's rows, sorted by ``order``; very many small groups cost little, as
    a task cuts the groups out of its sorted rows.  A task holds one group."""
    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = fn(pa.Table.from_batches(parts))
            if out is not None and out.num_rows:
                yield from out.select(target.names).cast(target).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                seam = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks().to_batches()[0]
                if len(_changes(seam, group)):
                    yield from made(held)
                    held = []
            cuts = [0, *_changes(batch, group).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield from made([*held, batch.slice(a, b - a)])
                held = []
            held.append(batch.slice(cuts[-1]))
        if held:
            yield from made(held)

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)
