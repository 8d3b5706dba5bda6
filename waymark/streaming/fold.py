"""Sequential folds over ordered rows of a key, in batch and in Structured Streaming.

A step takes a state (a dict of plain values) and a row (a dict) and returns the new state and an output row or None.
In batch, rows are dealt by key, sorted within partitions and folded as they pass, so a long trace is never held.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Step = Callable[[dict, dict], tuple[dict, dict | None]]


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)


def fold(rows: DataFrame, key: str, order: list[str], step: Step, start: dict, schema: StructType) -> DataFrame:
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, dict(start)
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row[key] != now:
                    now, state = row[key], dict(start)
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield _frame(out, names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def fold_stream(rows: DataFrame, key: str, order: list[str], step: Step, start: dict, schema: StructType) -> DataFrame:
    """The same fold over a stream: each micro-batch's rows of a key in order, the state kept between batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = schema.names

    def run(_, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else dict(start)
        out = []
        for row in pd.concat(list(batches)).sort_values(order, kind="stable").to_dict("records"):
            state, made = step(state, row)
            if made is not None:
                out.append(made)
        kept.update((json.dumps(state),))
        yield _frame(out, names)

    return rows.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)
