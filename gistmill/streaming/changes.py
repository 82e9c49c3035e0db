"""Changes of task rows as a stream: what was inserted, changed or removed, for each key, across restarts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: The status that takes a row away.
REMOVED = "removed"


def changes(tasks: DataFrame, key: str, status: str = "status", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(key, change, status, ts, seq) of a table of updates: inserted, changed or removed, in the order of (ts, seq).

    An update with the status that a row has, and the removal of a row that is not there, are no changes. A row that
    comes after its removal is inserted. Updates without a status are ignored.
    """
    before = F.lag(status).over(Window.partitionBy(key).orderBy(ts, seq))
    rows = tasks.where(F.col(key).isNotNull() & F.col(status).isNotNull()).withColumn("_before", before)
    alive = F.col("_before").isNotNull() & (F.col("_before") != REMOVED)
    change = F.when(F.col(status) == REMOVED, F.when(alive, REMOVED)).when(~alive, "inserted").when(F.col(status) != F.col("_before"), "changed")
    return rows.select(key, change.alias("change"), F.col(status).alias("status"), F.col(ts).alias("ts"), F.col(seq).alias("seq")).where("change IS NOT NULL")


class _Changes(StatefulProcessor):
    """Keeps a key's last status and its moment."""

    def __init__(self, key: str, status: str, ts: str, seq: str):
        self.names = key, status, ts, seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string, ts timestamp, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        name, status, ts, seq = self.names
        state = self.last.get() if self.last.exists() else None
        held, moment = (state[0], (pd.Timestamp(state[1]), state[2])) if state else (None, None)
        new = pd.concat(rows).sort_values([ts, seq])
        out = []
        for s, at, n in zip(new[status], new[ts], new[seq], strict=True):
            if moment is not None and (at, n) <= moment:
                continue  # older than what is known: late, or given twice
            alive = held is not None and held != REMOVED
            change = (REMOVED if alive else None) if s == REMOVED else "inserted" if not alive else "changed" if s != held else None
            held, moment = s, (at, n)
            if change:
                out.append((key[0], change, s, at, n))
        if moment is not None:
            self.last.update((held, moment[0].to_pydatetime(), int(moment[1])))
        yield pd.DataFrame(out, columns=[name, "change", "status", "ts", "seq"])

    def close(self) -> None:
        pass


def change_stream(tasks: DataFrame, key: str, status: str = "status", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """`changes` of a stream of updates. The state is a row for each key, in the state store of the query's checkpoint.

    Updates of one batch are put in order; one that is older than the key's last is ignored. It takes the RocksDB store:
    spark.sql.streaming.stateStore.providerClass must name it in the session.
    """
    kind = dict(tasks.dtypes)[key]
    plain = tasks.where(F.col(key).isNotNull() & F.col(status).isNotNull()).select(key, F.col(status), F.col(ts), F.col(seq).cast("long").alias(seq))
    schema = f"{key} {kind}, change string, status string, ts timestamp, seq long"
    return plain.groupBy(key).transformWithStateInPandas(_Changes(key, status, ts, seq), schema, "Append", "none")
