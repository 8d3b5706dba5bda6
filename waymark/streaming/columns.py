"""Folds over ordered rows whose state is columns: one slot for each key of a task, all keys advanced at once.

Rows are numbered within their key and pass in the order of their numbers, so that a slice of rows with one number
holds each key once and one step of numpy serves all of them. A task keeps the state of its keys (some numbers for each),
never their rows: long traces cost no memory, and more partitions mean fewer keys to a task. Keys with more rows than all
others are alone in their last slices; those go row by row.

Null keys count as one key. Rows that tie in the order come in any order, so the order should tell them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: A column of a slice: its values, or for lists the values of all rows and how many each row has.
Values = np.ndarray | tuple[np.ndarray, np.ndarray]
Advance = Callable[[dict[str, np.ndarray], dict[str, Values]], tuple[dict[str, np.ndarray], dict[str, Values], np.ndarray | None]]


@dataclass(frozen=True)
class ColumnStep:
    """`advance(state, rows)` gives the new state, the columns it `tells` and which rows tell (None: all).

    `reads` are the columns it needs; nulls reach it as NaN in doubles, False in booleans and 0 in integers, null lists
    as empty ones. A told column may be a pair of values and where they aren't null; a NaN told is null. Columns of the schema that it doesn't
    tell are copied from the row. `words` names the values of columns, told or of the state, that are places in a list.
    `one` is the same step for one row, with plain values and words, every column of the state in and out; it serves
    slices of fewer than `narrow` rows, where numpy's calls cost more than they save.
    """

    start: dict[str, float | int | bool]
    reads: tuple[str, ...]
    tells: tuple[str, ...]
    advance: Advance
    words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    one: Callable[[dict, dict], tuple[dict, dict | None]] | None = None
    narrow: int = 12

    def fresh(self, n: int) -> dict[str, np.ndarray]:
        return {k: np.full(n, v) for k, v in self.start.items()}


def _values(column: pa.Array) -> Values:
    if pa.types.is_list(column.type):
        return _values(column.flatten()), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if column.null_count:
        column = column.fill_null(float("nan") if pa.types.is_floating(column.type) else False if pa.types.is_boolean(column.type) else 0)
    return column.to_numpy(zero_copy_only=False)


def _column(values: np.ndarray, null: np.ndarray, words: tuple[str, ...] | None, kind: pa.DataType) -> pa.Array:
    if values.dtype.kind == "f":
        null = null | np.isnan(values)
    made = pa.array(values, mask=null)
    return (made if words is None else pa.DictionaryArray.from_arrays(made, pa.array(words))).cast(kind)


class _Told:
    """Columns that slices tell, in the order of the rows."""

    def __init__(self, step: ColumnStep):
        self.words, self.values, self.null, self.keep = step.words, {}, {}, []

    def add(self, out: dict[str, Values], kept: np.ndarray | None, n: int) -> None:
        for k, v in out.items():
            pair = isinstance(v, tuple)
            self.values.setdefault(k, []).append(v[0] if pair else v)
            self.null.setdefault(k, []).append(~v[1] if pair else np.zeros(n, bool))
        self.keep.append(np.ones(n, bool) if kept is None else kept)

    def add_rows(self, made: list[dict | None], names: list[str]) -> None:
        """Rows one by one, with words in place of their places."""
        kept = np.array([m is not None for m in made])
        out = {}
        for k in names:
            found = [None if m is None else m[k] for m in made]
            if k in self.words:
                found = [None if v is None else self.words[k].index(v) for v in found]
            there = np.array([v is not None for v in found])
            out[k] = (np.array([0 if v is None else v for v in found]), there)
        self.add(out, kept, len(made))

    def batch(self, rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        columns = []
        for f in schema:
            if f.name in self.values:
                columns.append(_column(np.concatenate(self.values[f.name]), np.concatenate(self.null[f.name]), self.words.get(f.name), f.type))
            else:
                columns.append(rows.column(f.name).cast(f.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(np.concatenate(self.keep)))


def _one_by_one(step: ColumnStep, state: dict[str, np.ndarray], slots: np.ndarray, columns: dict[str, Values], starts: dict, a: int, b: int) -> list[dict | None]:
    """Rows a to b by `step.one`; each slot's state is a dict meanwhile."""
    flat = {}
    for c, v in columns.items():
        if c in starts:
            values, cuts = v[0][starts[c][a] : starts[c][b]].tolist(), (starts[c][a : b + 1] - starts[c][a]).tolist()
            flat[c] = [values[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
        else:
            flat[c] = v[a:b].tolist()
    live, made = {}, []
    for slot, *row in zip(slots[a:b].tolist(), *flat.values()):
        was = live.get(slot)
        if was is None:
            was = {k: step.words[k][v[slot]] if k in step.words else v[slot].item() for k, v in state.items()}
        live[slot], told = step.one(was, dict(zip(flat, row)))
        made.append(told)
    for slot, now in live.items():
        for k, v in state.items():
            v[slot] = step.words[k].index(now[k]) if k in step.words else now[k]
    return made


def _advance(step: ColumnStep, state: dict[str, np.ndarray], batch: pa.RecordBatch, slots: np.ndarray, bounds: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """Slices of the batch in turn; `state` is changed in place."""
    columns = {c: _values(batch.column(c)) for c in step.reads}
    starts = {c: np.concatenate(([0], np.cumsum(v[1]))) for c, v in columns.items() if isinstance(v, tuple)}
    narrow = (np.diff(bounds) < step.narrow).tolist() if step.one is not None else [False] * (len(bounds) - 1)
    cuts, told, names = bounds.tolist(), _Told(step), [c for c in step.tells if c in schema.names]
    i = 0
    while i < len(narrow):
        j = i + 1
        if narrow[i]:
            while j < len(narrow) and narrow[j]:
                j += 1
            told.add_rows(_one_by_one(step, state, slots, columns, starts, cuts[i], cuts[j]), names)
        else:
            a, b = cuts[i], cuts[j]
            at = slots[a:b]
            rows = {c: (v[0][starts[c][a] : starts[c][b]], v[1][a:b]) if c in starts else v[a:b] for c, v in columns.items()}
            new, out, kept = step.advance({k: v[at] for k, v in state.items()}, rows)
            for k, v in new.items():
                state[k][at] = v
            told.add({k: out[k] for k in names}, kept, b - a)
        i = j
    return told.batch(batch, schema)


def _fresh_name(taken: list[str], name: str) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def fold_columns(rows: DataFrame, keys: list[str], order: list[str], step: ColumnStep, schema: StructType) -> DataFrame:
    """One shuffle by the keys, a sort for numbering and a sort by number; both sorts spill."""
    from pyspark.sql.pandas.types import to_arrow_schema

    n, at = _fresh_name(rows.columns, "n"), _fresh_name(rows.columns, "at")
    needed = list(dict.fromkeys([*step.reads, *(c for c in schema.names if c in rows.columns)]))
    numbered = rows.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    # rows of a key are neighbours here, so a row's place less its number is the key's own
    placed = numbered.select(*needed, n, (F.monotonically_increasing_id() - F.col(n)).alias(at)).sortWithinPartitions(n, at)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = np.empty(0, np.int64), step.fresh(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            number, place = batch.column(n).to_numpy(), batch.column(at).to_numpy()
            new = place[number == 1]
            if len(new):  # in rising order
                known = np.concatenate((known, new))
                state = {k: np.concatenate((state[k], v)) for k, v in step.fresh(len(new)).items()}
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [len(number)]))
            yield _advance(step, state, batch, np.searchsorted(known, place), bounds, arrow)

    return placed.mapInArrow(run, schema)


def fold_columns_stream(rows: DataFrame, keys: list[str], order: list[str], step: ColumnStep, schema: StructType, buckets: int = 200) -> DataFrame:
    """The same fold over a stream: each micro-batch's rows of a key in order.

    Keys fall into `buckets` by hash, a parameter; a bucket's state is one Arrow table of its keys, read and written
    whole when a micro-batch has rows of it. So a bucket should hold thousands of keys, not millions. It can't change
    for a started stream.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.streaming.state import GroupStateTimeout

    arrow = to_arrow_schema(schema)
    needed = list(dict.fromkeys([*keys, *order, *step.reads, *(c for c in schema.names if c in rows.columns)]))
    bucket = _fresh_name(rows.columns, "bucket")
    dealt = rows.select(*needed, F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias(bucket))
    came_as = to_arrow_schema(rows.select(*needed).schema)

    def run(_, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches), ignore_index=True).drop(columns=bucket)
        frame = frame.sort_values([*keys, *order], kind="stable", ignore_index=True)
        names = [f"state_{k}" for k in step.start]
        have = pa.ipc.open_stream(kept.get[0]).read_pandas() if kept.exists else frame.iloc[:0][keys].assign(**dict.fromkeys(names, 0))
        came = frame[keys].drop_duplicates()
        known = have[keys].merge(came, on=keys, how="outer").drop_duplicates(ignore_index=True)
        known["slot"] = np.arange(len(known))
        held = known.merge(have, on=keys, how="left", indicator="from").sort_values("slot")
        old = (held["from"] == "both").to_numpy()
        state = step.fresh(len(known))
        for k, name in zip(step.start, names):
            state[k][old] = held[name].to_numpy()[old]
        slot = frame[keys].merge(known, on=keys, how="left")["slot"].to_numpy()
        number = frame.groupby(keys, dropna=False).cumcount().to_numpy()
        turn = np.lexsort((slot, number))
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(number[turn])) + 1, [len(number)]))
        batch = pa.RecordBatch.from_pandas(frame.iloc[turn], schema=came_as, preserve_index=False)
        out = _advance(step, state, batch, slot[turn], bounds, arrow)
        after = pa.Table.from_pandas(known[keys].assign(**{name: state[k] for k, name in zip(step.start, names)}), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, after.schema) as writer:
            writer.write_table(after)
        kept.update((sink.getvalue().to_pybytes(),))
        yield out.to_pandas()

    return dealt.groupBy(bucket).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)
