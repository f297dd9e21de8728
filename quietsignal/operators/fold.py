"""An ordered pass over the rows of each key that carries a state, in memory that does not grow with a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

PLACE = "__place"


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], needs: list[str], begin: Callable[[dict[str, Any]], Any], step: Callable[[Any, pd.DataFrame], tuple[Any, list[list]]], added: list[StructField]) -> DataFrame:
    """``df`` with columns that depend on all earlier rows of the key in ``order``; they replace those of their names.

    ``begin`` makes a key's state from its first row, and ``step`` takes the state and the next rows of the key (their
    ``needs``), some at a time, and gives the new state and the values of ``added`` for them.  A window numbers the
    rows, which leaves them sorted by key and order in their partitions; so a key's rows pass in Arrow batches, other columns
    untouched, and only the state stays.  Null keys are a key; no rows give no rows.
    """
    by = [F.col(f"`{k}`") for k in keys] or [F.lit("all")]
    placed = df.withColumn(PLACE, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kinds, names = [to_arrow_type(f.dataType) for f in added], {f.name for f in added}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            frame = batch.select(list(dict.fromkeys([*needs, PLACE]))).to_pandas()
            cuts = sorted({0, *np.flatnonzero(frame[PLACE].to_numpy() == 1).tolist(), len(frame)})
            columns: list[list] = [[] for _ in added]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = frame.iloc[a:b]
                if part[PLACE].iloc[0] == 1:
                    state = begin(part.iloc[0].to_dict())
                state, values = step(state, part)
                for c, v in zip(columns, values, strict=True):
                    c += v
            kept = [c for c in batch.schema.names if c != PLACE and c not in names]
            yield pa.record_batch([*(batch.column(c) for c in kept), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*kept, *(f.name for f in added)])

    return placed.mapInArrow(work, StructType([*(f for f in df.schema.fields if f.name not in names), *added]))
