"""Windows of the last values and moving averages that a stream carries from batch to batch.

State per key is bounded: the last ``width`` values, their count and sum so far, and the moving average.  Rows of a micro-batch
are taken in their stated order, micro-batches as they come; a restart goes on from the checkpoint.  A null value
leaves the averages as they are and takes a place in the window, as in the batch form.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATE = "near array<double>, total double, n long, ema double"
_OUT = "median double, mean double, top double, global_mean double, ema double"


def advance(near: list, total: float, n: int, ema: float | None, value: float | None, width: int, momentum: float):
    """State and output after one more value."""
    near = [*near, value][-width:]
    if value is not None:
        total, n = total + value, n + 1
        ema = value if ema is None else momentum * ema + (1 - momentum) * value
    known = sorted(v for v in near if v is not None)
    shown = (known[math.ceil(len(known) / 2) - 1], sum(known) / len(known), known[-1]) if known else (None, None, None)
    return (near, total, n, ema), (*shown, total / n if n else None, ema)


def smoothed(events: DataFrame, key: str, order: str, value: str, width: int = 20, momentum: float = 0.99) -> DataFrame:
    """``key, order`` of every row with the lower median, mean and maximum of the last ``width`` values, the running mean and the moving average."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    names = [c.split()[0] for c in _OUT.split(", ")]

    def update(keys, frames, state):
        near, total, n, ema = state.get if state.exists else ([], 0.0, 0, None)
        own = (list(near), total, n, ema)
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for place, v in zip(rows[order], rows["_value"], strict=True):
            own, shown = advance(*own, None if pd.isna(v) else float(v), width, momentum)
            out.append((keys[0], place, *shown))
        state.update(own)
        yield pd.DataFrame(out, columns=[key, order, *names])

    rows = events.select(key, order, F.col(value).cast("double").alias("_value"))
    return rows.groupBy(key).applyInPandasWithState(update, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, {_OUT}", _STATE, "append", "NoTimeout")
