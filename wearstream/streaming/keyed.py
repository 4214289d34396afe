"""Folds over the rows of a key in order of seq, of a table and of a stream by the same code."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Tasks of a table's replay for each core, at least.
TASKS_A_CORE = 4


class Fold:
    """What is done with a key's rows. states: name to the schema of a value, or to the schemas of a map's key and value.

    begin makes an object from the stored states (a dictionary; empty at first), step gives a row's output or none, end
    gives the states to store; a null state is cleared.
    """

    states: dict[str, str | tuple[str, str]] = {}

    def begin(self, stored: dict) -> Any:
        raise NotImplementedError

    def step(self, now: Any, row: dict) -> tuple | list[tuple] | None:
        raise NotImplementedError

    def end(self, now: Any) -> dict:
        raise NotImplementedError


def table_of(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*found) if found else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, schema)], schema=schema)


def rows_from(step_out: tuple | list[tuple] | None, key: Any) -> list[tuple]:
    if step_out is None:
        return []
    return [(key, *x) for x in step_out] if isinstance(step_out, list) else [(key, *step_out)]


def plain(column: pd.Series) -> list:
    """A column's values as Python's own, null ones as None, arrays as lists."""
    return [list(x) if isinstance(x, np.ndarray) else None if x is None or x is pd.NA or x != x else x for x in column.tolist()]


class KeyedState(StatefulProcessor):
    """A fold as a stream's processor: state is typed, and loaded and stored once in a trigger."""

    def __init__(self, fold: Fold, columns: list[str], whole: list[str], schema: pa.Schema):
        self.fold, self.columns, self.whole, self.schema = fold, columns, whole, schema
        self.names = {n: StructType.fromDDL(s[1] if isinstance(s, tuple) else s).names for n, s in fold.states.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = {n: handle.getMapState(n, *s) if isinstance(s, tuple) else handle.getValueState(n, s) for n, s in self.fold.states.items()}

    def stored(self) -> dict:
        out: dict = {}
        for n, s in self.fold.states.items():
            if isinstance(s, tuple):
                out[n] = {k[0]: dict(zip(self.names[n], v)) for k, v in self.held[n].iterator()} if self.held[n].exists() else {}
            else:
                out[n] = dict(zip(self.names[n], self.held[n].get())) if self.held[n].exists() else None
        return out

    def store(self, states: dict) -> None:
        for n, s in self.fold.states.items():
            held, value = self.held[n], states[n]
            if not isinstance(s, tuple):
                held.clear() if value is None else held.update(tuple(value[c] for c in self.names[n]))
                continue
            if not value:
                held.clear()
            for k, v in value.items():
                held.updateValue((k,), tuple(v[c] for c in self.names[n]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values("seq", kind="stable")
        now, found = self.fold.begin(self.stored()), []
        values = [[None if x is None else int(x) for x in plain(frame[c])] if c in self.whole else plain(frame[c]) for c in self.columns]
        for row in zip(*values):
            found += rows_from(self.fold.step(now, dict(zip(self.columns, row))), key[0])
        self.store(self.fold.end(now))
        yield table_of(found, self.schema).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype()}.get)

    def close(self) -> None:
        pass


def fold(rows: DataFrame, key: str, columns: list[str], out: str, by: Fold) -> DataFrame:
    """The outputs of a fold over each key's rows in order of seq (of equal seqs: of the other columns).

    A table is replayed in the order of all its rows, sorted by Spark and read batch by batch, in a fixed number of tasks:
    folds are costly and their rows short, so by their bytes Spark would merge them into few. In a stream, triggers are
    taken as they come and a trigger's rows of a key are sorted; its state is in RocksDB, to which this sets the session.
    """
    given = rows.select(key, *columns)
    schema = to_arrow_schema(StructType.fromDDL(out))
    if given.isStreaming:
        if given.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
            given.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        whole = [f.name for f in given.schema if f.dataType.typeName() in ("long", "integer")]
        return given.groupBy(key).transformWithStateInPandas(KeyedState(by, columns, whole, schema), out, "Append", "None")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            found: list[tuple] = []
            for one, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (one,) != at:
                    at, now = (one,), by.begin({})
                found += rows_from(by.step(now, {c: None if isinstance(v, float) and v != v else v for c, v in zip(columns, row)}), one)
            yield table_of(found, schema)

    session = given.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * session.sparkContext.defaultParallelism)
    return given.repartition(tasks, key).sortWithinPartitions(key, *columns).mapInArrow(replay, out)
