"""Running sums in an order over all rows, or over keys of any size, without a task that sees a whole key.

Rows are dealt by range of (key, order), so that a key of many rows covers several tasks; each task sums its own range,
and what earlier ranges of a key add up to is joined on afterwards: one number a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType
from pyspark.sql.window import Window

from ..kept import kept


def _starts(batch: pa.RecordBatch, by: list[str], last: tuple | None) -> np.ndarray:
    """Whether each row begins a key, the first one compared with the last row before it."""
    fresh = np.zeros(batch.num_rows, bool)
    for c in by:
        code = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= code[1:] != code[:-1]
    fresh[0] = last is None or last != tuple(batch.column(c)[0].as_py() for c in by)
    return fresh


def _sums(by: list[str], names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, leading, done, carried = TaskContext.get().partitionId(), None, True, 0, dict.fromkeys(names, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = _starts(batch, by, last)
            begins, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1  # group -1 goes on from the batch before
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for name in names:
                value = batch.column(name).to_numpy(zero_copy_only=False)
                total = np.cumsum(value)
                total -= np.append(total[begins] - value[begins], -carried[name])[group]
                carried[name] = total[-1]
                columns[name] = pa.array(total, batch.column(name).type)
            columns["_part"] = pa.array(np.full(n, part, np.int32))
            columns["_at"] = pa.array(np.arange(done, done + n))
            columns["_head"] = pa.array((group == (0 if last is None else -1)) & leading)
            leading &= len(begins) == (last is None)
            last, done = tuple(batch.column(c)[-1].as_py() for c in by), done + n
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def running(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in `sums`, the sum of its values over the rows of a key up to and including this one.

    by: key columns, none for all rows; null is a key like others. Rows that tie in `order` are summed in any order.
    Null values count 0, an empty table stays empty; the names `_part`, `_at` and `_head` are taken meanwhile.
    Integers stay exact; doubles are added range by range, so the last digits may differ from those of a single pass.
    What is broadcast has a row for each range at most.
    """
    names = list(sums)
    columns = [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    plain = df.withColumns({n: F.coalesce(v, F.lit(0)) for n, v in sums.items()})
    whole = {n: plain.schema[n].dataType.typeName() in ("byte", "short", "integer", "long") for n in names}
    plain = plain.withColumns({n: F.col(n).cast("long" if whole[n] else "double") for n in names})
    schema = StructType([*plain.schema.fields]).add("_part", IntegerType()).add("_at", LongType()).add("_head", BooleanType())
    dealt = plain.repartitionByRange(*columns).sortWithinPartitions(*columns)
    local = kept(dealt.mapInArrow(_sums(by, names), schema), "running")

    # only the key that a range begins with has rows in earlier ranges
    keys = F.broadcast(local.where("_head").select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by))).distinct())
    met = local.join(keys, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by))), "left_semi") if by else local
    ends = met.groupBy("_part", *by).agg(*(F.max_by(n, "_at").alias(f"_{n}") for n in names), F.max("_head").alias("_head"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # rows are ranges here
    offsets = ends.select("_part", "_head", *(F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in names)).where("_head")
    out = local.join(F.broadcast(offsets), ["_part", "_head"], "left")
    return out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in names}).select(*plain.columns)
