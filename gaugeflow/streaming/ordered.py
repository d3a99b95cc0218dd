"""Rows of a stream in event-time order: a station's rows wait in slots of time and leave slot by slot."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chunks import KEY, bucket, micros

SLOT = "_slot"


class Release(StatefulProcessor):
    """Holds the rows of one (station, slot) until the watermark passes the slot's end.

    What a micro-batch brings is appended as one packed value; the timer of the
    slot reads all values once, hands the rows on in time order and deletes
    them. So a row is written once and read once, however many micro-batches
    pass, and a worker holds one slot of one station.
    """

    def __init__(self, columns: list[str], ts: str, width: int):
        self.columns, self.ts, self.width = columns, ts, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pa.concat_tables([pa.Table.from_pandas(r, preserve_index=False) for r in rows], promote_options="permissive")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        if not self.waiting.exists():
            self.handle.registerTimer((key[1] + 1) * self.width // 1000)
        self.waiting.appendValue((sink.getvalue().to_pybytes(),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [pa.ipc.open_stream(value).read_all() for (value,) in self.waiting.get()]
        self.waiting.clear()
        rows = pa.concat_tables(held, promote_options="permissive").to_pandas().sort_values(self.ts, kind="stable")
        yield rows.assign(**{KEY: key[0]})[self.columns]

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, slot: float = 60.0, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """The rows of ``stream``, each slot of ``slot`` seconds once no more of it can come.

    Every micro-batch of the result holds whole slots, and no later one holds an
    earlier time of the same station. The state is keyed by station and slot, so
    a station with most of the rows is held and sorted by many tasks. Rows with
    equal times keep the order of their arrival. Rows older than the watermark
    are dropped by the engine (``drain`` counts them); rows without station or
    time are an error.
    """
    width = micros(slot)
    missing = F.col(KEY).isNull() | F.col(ts).isNull()
    number = F.when(missing, F.raise_error(F.lit("a row lacks its station or time")).cast("long")).otherwise(bucket(F.unix_micros(F.col(ts)), width))
    held = stream.withWatermark(ts, delay).withColumn(SLOT, number)
    return held.groupBy(KEY, SLOT).transformWithStateInPandas(Release(stream.columns, ts, width), stream.schema, "Append", "EventTime")
