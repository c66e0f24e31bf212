"""The time grid: slots, packing and unpacking, first in window, differences.

Long form has one row for each sample; packed form one row for each series and chunk
with a list of ``width`` slots, NULL where no sample is stored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.schema import GridMeta
from tsq.timemath import TimeRange, from_micros, micros


def slot(time: Column, kind: T.DataType, grid: GridMeta) -> Column:
    """The slot of a time: whole units since the grid's start, rounded down."""
    return floor_div(micros(time, kind) - grid.start_at.millis * 1000, grid.unit.millis * 1000)


def floor_div(a: Column, b: int) -> Column:
    """Whole quotient rounded down, in whole numbers throughout."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b).cast("long"))


def slot_start(number: Column, kind: T.DataType, grid: GridMeta) -> Column:
    return from_micros(number * (grid.unit.millis * 1000) + grid.start_at.millis * 1000, kind)


def slot_range(grid: GridMeta, wanted: TimeRange) -> tuple[int | None, int | None]:
    """The slots of a range: the whole slot that holds the start is in, the slot that
    holds an unaligned end is out."""
    unit, start = grid.unit.millis, grid.start_at.millis
    low = None if wanted.start is None else (wanted.start.millis - start) // unit
    high = None if wanted.end is None else (wanted.end.millis - start) // unit
    return low, high


def first_in(
    df: DataFrame, keys: Sequence[Column | str], value: str, order: Column, name: str | None = None
) -> DataFrame:
    """The first value that is not NULL in each group; groups of NULLs give NULL.
    Reduced before the shuffle, so a hot series stays small."""
    return df.groupBy(*keys).agg(
        F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order)).alias(name or value)
    )


def order_of(df: DataFrame, time: str, tie: str | None) -> Column:
    """The order of samples: by time, then by the tie-breaker.  A whole-numbered tie is
    joined with the time to one number, which keeps the aggregation a hash aggregation
    (a struct would have it sort its input)."""
    if tie is None:
        return F.col(time)
    if not isinstance(df.schema[tie].dataType, T.IntegralType):
        return F.struct(time, tie)
    us = micros(F.col(time), df.schema[time].dataType).cast("decimal(18,0)")
    # The tie moves to 0 <= tie < 2**64, so it never reaches the next microsecond.
    moved = F.coalesce(F.col(tie), F.lit(0)).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return us * F.lit(str(1 << 64)).cast("decimal(20,0)") + moved


def gridded(
    df: DataFrame, labels: Sequence[str], time: str, value: str, grid: GridMeta, tie: str | None = None
) -> DataFrame:
    """(labels, slot, value): the first sample of each series in each slot."""
    kind = df.schema[time].dataType
    at = slot(F.col(time), kind, grid).alias("slot")
    return first_in(df, [*labels, at], value, order_of(df, time, tie))


def pack(
    df: DataFrame, labels: Sequence[str], time: str, value: str, grid: GridMeta, tie: str | None = None
) -> DataFrame:
    """(labels, chunk_start, value list of ``width`` slots) of the long form.  A chunk
    holds at most ``width`` samples of a series, so a list is bounded by the grid."""
    kind = df.schema[time].dataType
    width = grid.width
    cells = gridded(df, labels, time, value, grid, tie)
    chunk = floor_div(F.col("slot"), width).alias("chunk")
    inside = F.pmod(F.col("slot"), F.lit(width)).cast("int")
    lists = cells.groupBy(*labels, chunk).agg(
        F.sort_array(F.collect_list(F.struct(inside.alias("k"), F.col(value).alias("v")))).alias("cells")
    )

    def empty(n: Column) -> Column:
        return F.array_repeat(F.lit(None).cast(df.schema[value].dataType), n)

    def upto(cell: Column, i: Column) -> Column:
        """The empty slots before a stored one, and its sample."""
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("cells"), i - 1)["k"])
        return F.concat(empty(cell["k"] - before - 1), F.array(cell["v"]))

    rest = empty(F.lit(width - 1) - F.element_at("cells", -1)["k"])
    dense = F.concat(F.flatten(F.transform("cells", upto)), rest)
    return lists.select(
        *labels, slot_start(F.col("chunk") * width, kind, grid).alias("chunk_start"), dense.alias(value)
    )


def unpack(
    df: DataFrame,
    labels: Sequence[str],
    chunk: str,
    values: Sequence[str],
    grid: GridMeta,
    time: str = "ts",
    extra: Sequence[str] = (),
) -> DataFrame:
    """(labels, ts, values) of the packed form; slots without any sample give no row."""
    kind = df.schema[chunk].dataType
    zipped = F.arrays_zip(*[F.col(v) for v in values])
    step = F.col("_pos").cast("long") * F.lit(grid.unit.millis * 1000)
    at = from_micros(micros(F.col(chunk), kind) + step, kind)
    rows = df.select(*labels, *extra, chunk, F.posexplode(zipped).alias("_pos", "_cell"))
    stored = [F.col("_cell")[v].isNotNull() for v in values]
    return rows.where(reduce(lambda a, b: a | b, stored)).select(
        *labels, *extra, at.alias(time), *[F.col("_cell")[v].alias(v) for v in values]
    )


def trim(df: DataFrame, chunk: str, values: Sequence[str], grid: GridMeta, wanted: TimeRange) -> DataFrame:
    """Packed rows that overlap the range, their lists cut to its slots.

    Chunks are pruned by a bound on the chunk's start, which reaches the scan."""
    kind = df.schema[chunk].dataType
    span = grid.unit * grid.width
    low_bound = None if wanted.start is None else wanted.start - span
    near = TimeRange(low_bound, wanted.end).predicate(F.col(chunk), kind)
    kept = df if near is None else df.where(near)
    if wanted.is_empty():
        return kept.where(F.lit(False))
    low, high = slot_range(grid, wanted)
    first = slot(F.col(chunk), kind, grid)
    start = F.lit(0) if low is None else F.greatest(F.lit(low) - first, F.lit(0)).cast("int")
    stop = F.lit(grid.width) if high is None else F.least(F.lit(high) - first, F.lit(grid.width)).cast("int")
    cut = kept.withColumns({"_from": start, "_to": stop}).where("_from < _to")
    lists = {v: F.slice(v, F.col("_from") + 1, F.col("_to") - F.col("_from")) for v in values}
    moved = {chunk: slot_start(first + F.col("_from"), kind, grid)}
    return cut.withColumns({**lists, **moved}).drop("_from", "_to")


def differences(
    df: DataFrame, labels: Sequence[str], time: str, value: str, grid: GridMeta, tie: str | None = None
) -> DataFrame:
    """Long-form rate: (labels, ts, value) for each slot whose slot before also holds a
    sample, stamped with the later slot.

    Each sample is sent to its own slot and to the next one and reduced there, so there
    is one shuffle by series and slot, counted down before it: no series is sorted or
    gathered, however hot it is."""
    kind = df.schema[time].dataType
    own = F.struct(F.lit(0).alias("lag"))
    late = F.struct(F.lit(1).alias("lag"))
    moved = df.where(F.col(value).isNotNull()).withColumn("_lag", F.explode(F.array(own, late)))
    at = (slot(F.col(time), kind, grid) + F.col("_lag.lag")).alias("slot")
    order = order_of(df, time, tie)

    def pick(lag: int) -> Column:
        return F.min_by(F.col(value), F.when(F.col("_lag.lag") == lag, order))

    pairs = moved.groupBy(*labels, at).agg(pick(0).alias("_now"), pick(1).alias("_before"))
    same_type = df.schema[value].dataType
    difference = (F.col("_now") - F.col("_before")).cast(same_type).alias(value)
    return pairs.where("_now is not null and _before is not null").select(
        *labels, slot_start(F.col("slot"), kind, grid).alias(time), difference
    )
