"""Recurrences over streams of ticks: the operators of a batch, with their states kept by symbol in the state store.

A query that starts again from its checkpoint goes on with the states that it had, so nothing has to be
saved beside it. Each operator's state is a row of its own schema and not a pickle, so other code can read it. Within a micro-batch a symbol's rows are put in order; a row that is not later than all
rows before it is dropped, as an earlier state cannot be had again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tickloom.operators.recurrences import Recurrence, apply


class _Processor(StatefulProcessor):
    def __init__(self, ops: tuple[Recurrence, ...], order: str, columns: list[str]):
        self.ops, self.order, self.columns = ops, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")
        self.kept = [handle.getValueState(f"state_{k}_{type(op).__name__}", op.kept) for k, op in enumerate(self.ops)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable").drop_duplicates(self.order)
        if self.last.exists():
            frame = frame[frame[self.order] > self.last.get()[0]]
        if len(frame):
            states = [op.unpack(tuple(held.get())) if held.exists() else op.start() for op, held in zip(self.ops, self.kept, strict=True)]
            found = apply(frame, self.ops, states)
            for op, held, state in zip(self.ops, self.kept, states, strict=True):
                held.update(op.pack(state))
            self.last.update((int(frame[self.order].iloc[-1]),))
            yield found[self.columns]

    def close(self) -> None:
        pass


def stream(ticks: DataFrame, *ops: Recurrence, key: str = "symbol", order: str = "timestamp_ns") -> DataFrame:
    """A stream's accepted rows with the outputs of recurrences; ``order`` is a whole number that rises in a symbol."""
    ddl = ", ".join([*(f"`{n}` {t}" for n, t in ticks.dtypes), *(op.outputs for op in ops)])
    columns = [*ticks.columns, *(n for op in ops for n in op.names)]
    processor = _Processor(ops, order, columns)
    schema = StructType.fromDDL(ddl)
    return ticks.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")
