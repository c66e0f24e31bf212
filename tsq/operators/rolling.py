"""Totals over trailing periods for every entity and day (p3).

Samples are reduced to daily values before anything is gathered, so an entity has at
most one row a day however busy it is.  Entities are then spread over sorted
partitions, and a two-stack queue keeps the window: the back stack folds what comes in,
the front stack holds the folds of what is still to leave, and a result is the fold of
both tops.  No value is ever taken back, so any associative fold works, minimum and
maximum too.  The calendar is the same for all entities, so one queue serves a batch of
entities as lanes of an array.

Defined results: every entity with a row in the calendar has a row for each day of it,
also before its first and after its last; days without samples count as the fold's
neutral element (totals 0, minimum and maximum NULL); redelivered samples count once;
NULL values add nothing; rows without entity or outside the calendar are left out.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES = 4096  # entities in one batch


@dataclass(frozen=True)
class Fold:
    """An associative fold over days: the daily column it reads, its operation on arrays,
    its neutral element for whole numbers and for doubles, and whether a window that
    holds nothing is NULL (else the neutral element)."""

    source: str
    op: Callable
    whole: int
    real: float
    null_if_empty: bool = False


_LONG = np.iinfo(np.int64)
# More folds may be added under names of their own.
FOLDS: dict[str, Fold] = {
    "sum": Fold("total", np.add, 0, 0.0),
    "count": Fold("n", np.add, 0, 0.0),
    "min": Fold("least", np.minimum, _LONG.max, np.inf, True),
    "max": Fold("most", np.maximum, _LONG.min, -np.inf, True),
}


class TwoStackQueue:
    """A queue of arrays (one lane an entity) that folds its content at any time."""

    def __init__(self, fold: Callable, neutral: np.ndarray):
        self.fold, self.neutral = fold, neutral
        self.front: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        self.back_fold = neutral

    def __len__(self) -> int:
        return len(self.front) + len(self.back)

    def push(self, values: np.ndarray) -> None:
        self.back.append(values)
        self.back_fold = self.fold(self.back_fold, values)

    def pop(self) -> None:
        if not self.front:
            folded = self.neutral
            while self.back:
                folded = self.fold(self.back.pop(), folded)
                self.front.append(folded)
            self.back_fold = self.neutral
        self.front.pop()

    def value(self) -> np.ndarray:
        return self.fold(self.front[-1], self.back_fold) if self.front else self.back_fold


def daily(
    samples: DataFrame, entity: str, time: str, value: str, sample_id: str, first: date, last: date
) -> DataFrame:
    """(entity, day, total, least, most, n) of the samples of each entity and day, day 0
    being ``first``; each sample id once."""
    day = F.datediff(F.col(time).cast("date"), F.lit(first))
    rows = samples.select(
        F.col(entity).alias("entity"), day.alias("day"), F.col(value).alias("v"), F.col(sample_id).alias("id")
    ).where(F.col("entity").isNotNull() & F.col("day").between(0, (last - first).days))
    # Redelivered rows repeat all values, so any one of an id's rows stands for it.
    once = rows.dropDuplicates(["id", "entity", "day", "v"])
    return once.groupBy("entity", "day").agg(
        F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("n")
    )


def trailing(days: DataFrame, first: date, last: date, widths: Sequence[int], folds: Sequence[str]) -> DataFrame:
    """One row for each entity of ``days`` and each day of the calendar, with a column
    ``{fold}_{width}`` for each fold over the last ``width`` days, the day included."""
    used = {f: FOLDS[f] for f in folds}
    # Whole numbers stay whole, all others are doubles.
    real = {f: not isinstance(days.schema[x.source].dataType, T.IntegralType) for f, x in used.items()}
    neutral = {f: x.real if real[f] else x.whole for f, x in used.items()}
    names = [(f, w, f"{f}_{w}") for f in folds for w in widths]
    length = (last - first).days + 1
    schema = "entity string, day int, " + ", ".join(f"{n} {'double' if real[f] else 'bigint'}" for f, _, n in names)
    kinds = [(n, pa.float64() if real[f] else pa.int64()) for f, _, n in names]
    arrow = pa.schema([("entity", pa.string()), ("day", pa.int32()), *kinds])

    def windows(grid: np.ndarray, fold: str, width: int) -> np.ndarray:
        queue = TwoStackQueue(used[fold].op, np.full(grid.shape[1], neutral[fold]))
        out = np.empty_like(grid)
        for d in range(length):
            queue.push(grid[d])
            if len(queue) > width:
                queue.pop()
            out[d] = queue.value()
        return out

    def results(entities: list[str], lanes: np.ndarray, at: np.ndarray, values: dict) -> pa.RecordBatch:
        grids = {}
        for fold in folds:
            v, valid = values[used[fold].source]
            grid = np.full((length, len(entities)), neutral[fold])
            grid[at[valid], lanes[valid]] = v[valid]
            grids[fold] = grid
        columns = [
            pa.array(np.repeat(np.array(entities, object), length), pa.string()),
            pa.array(np.tile(np.arange(length, dtype=np.int32), len(entities))),
        ]
        for fold, width, _ in names:
            out = windows(grids[fold], fold, width).T.ravel()
            columns.append(pa.array(out, mask=out == neutral[fold] if used[fold].null_if_empty else None))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by entity; a batch may end within one, whose rows are kept
        # for the next.
        held: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b])
            held = table if held is None else pa.concat_tables([held, table])
            ends = held["entity"].combine_chunks().dictionary_encode()
            ends = ends.combine_chunks() if isinstance(ends, pa.ChunkedArray) else ends
            if len(ends.dictionary) <= LANES:
                continue
            keep = int(np.searchsorted(ends.indices.to_numpy(), len(ends.dictionary) - 1))
            yield from emit(held.slice(0, keep))
            held = held.slice(keep)
        if held is not None and held.num_rows:
            yield from emit(held)

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = table["entity"].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        lanes = coded.indices.to_numpy().astype(np.int64)
        values = {}
        for name in {x.source for x in used.values()}:
            col = table[name].combine_chunks()
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            valid = col.is_valid().to_numpy(zero_copy_only=False)
            values[name] = (col.fill_null(0).to_numpy(zero_copy_only=False), valid)
        at = table["day"].to_numpy()
        entities = coded.dictionary.to_pylist()
        for i in range(0, len(entities), 512):
            part = (lanes >= i) & (lanes < i + 512)
            yield results(
                entities[i : i + 512], lanes[part] - i, at[part], {k: (v[part], ok[part]) for k, (v, ok) in values.items()}
            )

    columns = [F.col(x.source).cast("double" if real[f] else "long").alias(x.source) for f, x in used.items()]
    days = days.select("entity", "day", *dict(zip([x.source for x in used.values()], columns)).values())
    spread = days.repartition("entity").sortWithinPartitions("entity", "day")
    return spread.mapInArrow(kernel, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
