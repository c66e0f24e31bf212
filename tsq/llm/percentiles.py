"""Percentiles of very large numeric columns by distributed multi-select (p5).

A partial result is, for one plan, UTC day and group of one partition, the sorted
distinct values and how often each occurs.  Partial results of any partitions and days
combine.  A wanted percentile is the value at a rank of the combined values.

Select: as long as more than ``local_limit`` values of a group could still be the
wanted one, each partial result proposes the median of its candidates, the weighted
median of the proposals becomes the pivot, candidates below, at and above it are
counted, and the ranges the rank is not in are ruled out and their values discarded.
Each round rules out about half.  What is left fits one task, which picks the value.  Groups that fit one task
from the start (most) skip the rounds.

Error: none in rank.  The p-th percentile of n values is the value at rank
ceil(n * p), so ``rank_error`` is 0; whole numbers beyond 2**53 are rounded to doubles.

Defined results: NULL and NaN are left out, infinite values are values; -0.0 is 0.0; a
group without values has no row; a missing label is a group of its own; every stored
row counts, repeated ones too; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsq.llm import runs
from tsq.operators.frequency import label_text
from tsq.plans.session import cut, join_small

PERMILLES = (500, 900, 950, 990, 999)
NAMES = ("p50", "p90", "p95", "p99", "p999")
LOCAL_LIMIT = 1 << 18  # values of one group that one task may hold
TASK_VALUES = 1 << 20  # values of several groups that a task works on at once
ALL = -(1 << 31)  # the day of a group over all days
PARTIAL = "plan_id int, by_values array<string>, on_day int, n bigint, n_values bigint, vals binary, times binary"
INSTANCE = ["plan_id", "by_values", "on_day"]
KEY = ["plan_id", "by_values"]


def partial_values(rows: DataFrame, plans: list[dict], time: str) -> DataFrame:
    """Value frequencies of each input partition by plan, group and day.  A plan has
    plan_id, by (label columns, cast to string for the key) and field (numeric)."""
    label = {c: f"label_{i}" for i, c in enumerate(sorted({c for p in plans for c in p["by"]}))}
    field = {c: f"field_{i}" for i, c in enumerate(sorted({p["field"] for p in plans}))}
    wanted = [F.datediff(F.col(time).cast("date"), F.lit("1970-01-01").cast("date")).alias("on_day")]
    wanted += [label_text(rows, c).alias(a) for c, a in label.items()]
    wanted += [F.col(c).cast("double").alias(a) for c, a in field.items()]
    specs = [(p["plan_id"], [label[c] for c in p["by"]], field[p["field"]]) for p in plans]
    schema = pa.schema(
        [
            ("plan_id", pa.int32()),
            ("by_values", pa.list_(pa.string())),
            ("on_day", pa.int32()),
            ("n", pa.int64()),
            ("n_values", pa.int64()),
            ("vals", pa.binary()),
            ("times", pa.binary()),
        ]
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs.tables(batches):
            for plan_id, by, name in specs:
                cell, first = runs.codes(table, ["on_day", *by])
                v = runs._flat(table[name]).fill_null(np.nan).to_numpy(zero_copy_only=False)
                live = ~np.isnan(v)
                cell, v = cell[live], v[live] + 0.0
                cell, v, times = frequencies(cell, v, None)
                at = runs.starts_of(cell)
                rows = first[cell[at]]
                ends = np.append(at, len(v))
                sums = np.add.reduceat(times, at) if len(at) else times[:0]
                yield from pa.table(
                    [
                        pa.array(np.full(len(at), plan_id, np.int32)),
                        runs.lists(table, by, rows),
                        runs._flat(table["on_day"]).take(pa.array(rows)),
                        pa.array(sums),
                        pa.array(np.diff(ends)),
                        runs.binaries(v.view(np.uint8), ends * 8),
                        runs.binaries(times.view(np.uint8), ends * 8),
                    ],
                    schema=schema,
                ).to_batches(max_chunksize=20_000)

    return rows.select(*wanted).mapInArrow(kernel, PARTIAL)


def frequencies(cell: np.ndarray, v: np.ndarray, times: np.ndarray | None):
    """Distinct (cell, value) pairs in order and how often each occurs."""
    order = np.lexsort((v, cell))
    cell, v = cell[order], v[order]
    at = runs.starts_of(cell, v)
    if times is None:
        times = np.diff(np.append(at, len(v)))
    else:
        times = np.add.reduceat(times[order], at) if len(at) else times[:0]
    return cell[at], v[at], times.astype(np.int64)


def ranks(n: np.ndarray, permilles=PERMILLES) -> np.ndarray:
    """1-based ranks of the percentiles of n values, one row for each n."""
    return (np.asarray(n)[:, None] * np.array(permilles)[None, :] + 999) // 1000


def _values(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, frequencies and partial result of each value."""
    raw, offsets = runs.payload(table["vals"])
    times, _ = runs.payload(table["times"])
    run = np.repeat(np.arange(table.num_rows), np.diff(offsets) // 8)
    return np.frombuffer(raw.tobytes(), np.float64), np.frombuffer(times.tobytes(), np.int64), run


def _pick(cell, v, times, permilles=PERMILLES):
    """Cells, their sizes and the values at their percentiles' ranks."""
    cell, v, times = frequencies(cell, v, times)
    at = runs.starts_of(cell)
    if not len(at):
        return cell[:0], times[:0], np.zeros((0, len(permilles)))
    total = np.cumsum(times)
    n = np.add.reduceat(times, at)
    before = total[at] - times[at]
    where = np.searchsorted(total, before[:, None] + ranks(n, permilles))
    return cell[at], n, v[where]


def _small(partials: DataFrame, daily_only: bool) -> DataFrame:
    """Percentiles of groups that fit one task: by day, and over all days unless
    ``daily_only``.  A task works on many groups at once, in the order of their keys."""
    group = ["plan_id", "key", "on_day"] if daily_only else ["plan_id", "key"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += pc.sum(b["n_values"]).as_py() or 0
            if n < TASK_VALUES:
                continue
            table = pa.Table.from_batches(held)
            same = np.ones(table.num_rows, bool)
            for name in group:
                same &= pc.equal(table[name], table[name][-1]).to_numpy()
            cut_at = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut_at:  # the last group may go on in the next batch
                yield from select(table.slice(0, cut_at))
            held = table.slice(cut_at).to_batches()
            n = sum(pc.sum(x["n_values"]).as_py() or 0 for x in held)
        if held:
            yield from select(pa.Table.from_batches(held))

    def select(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        v, times, run = _values(table)
        for daily in (True,) if daily_only else (True, False):
            cell, first = runs.codes(table, ["plan_id", "key", "on_day"] if daily else ["plan_id", "key"])
            c, n, picked = _pick(cell[run], v, times)
            rows = pa.array(first[c])
            columns = {
                "plan_id": table["plan_id"].take(rows),
                "by_values": table["by_values"].take(rows),
                "on_day": table["on_day"].take(rows) if daily else pa.array(np.full(len(c), ALL, np.int32)),
                "n": pa.array(n),
                **{name: pa.array(np.ascontiguousarray(picked[:, i])) for i, name in enumerate(NAMES)},
            }
            yield from pa.table(columns).cast(schema).to_batches(max_chunksize=50_000)

    schema = pa.schema(
        [
            ("plan_id", pa.int32()),
            ("by_values", pa.list_(pa.string())),
            ("on_day", pa.int32()),
            ("n", pa.int64()),
            *[(name, pa.float64()) for name in NAMES],
        ]
    )
    key = F.array_join(F.transform("by_values", lambda x: F.coalesce(x, F.lit("\x00"))), "\x1f")
    keyed = partials.withColumn("key", key)
    out = "plan_id int, by_values array<string>, on_day int, n bigint, " + ", ".join(f"{x} double" for x in NAMES)
    return keyed.repartition(*group).sortWithinPartitions(*group).mapInArrow(kernel, out)


def search(v: np.ndarray, begin: np.ndarray, end: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """For each item the place of x in the sorted stretch begin <= i < end of v, after
    equal values if ``right``: a binary search of all items at once."""
    low, high = begin.copy(), end.copy()
    while len(v):
        going = low < high
        if not going.any():
            break
        mid = (low + high) // 2
        at = v[np.minimum(mid, len(v) - 1)]
        below = going & ((at <= x) if right else (at < x))
        low, high = np.where(below, mid + 1, low), np.where(going & ~below, mid, high)
    return low


class Open:
    """Partial results of a batch with the open ranges of their instance: one item for
    each partial result and range."""

    def __init__(self, batch: pa.RecordBatch):
        table = pa.Table.from_batches([batch])
        raw, offsets = runs.payload(table["vals"])
        times, _ = runs.payload(table["times"])
        self.v = np.frombuffer(raw.tobytes(), np.float64)
        self.times = np.frombuffer(times.tobytes(), np.int64)
        self.upto = np.concatenate([[0], np.cumsum(self.times)])
        self.bounds = offsets // 8
        inst = table["inst"].to_numpy()
        lists = runs._flat(table["open"])
        sizes = np.diff(lists.offsets.to_numpy())
        items = lists.flatten()
        self.row = np.repeat(np.arange(table.num_rows), sizes)
        self.inst = inst[self.row]
        self.fields = {f.name: items.field(f.name).to_numpy(zero_copy_only=False) for f in items.type}
        self.begin, self.end = self.bounds[self.row], self.bounds[self.row + 1]

    def place(self, name: str, right: bool) -> np.ndarray:
        return search(self.v, self.begin, self.end, self.fields[name], right)


def weighted_medians(group: list[np.ndarray], v: np.ndarray, weight: np.ndarray):
    """The first row, the weighted median and the whole weight of each group."""
    order = np.lexsort((v, *group))
    v, weight = v[order], weight[order]
    at = runs.starts_of(*[g[order] for g in group])
    if not len(at):
        return order[:0], v[:0], weight[:0]
    total = np.cumsum(weight)
    whole = np.add.reduceat(weight, at)
    before = total[at] - weight[at]
    return order[at], v[np.searchsorted(total, before + (whole + 1) // 2)], whole


_PROPOSAL = pa.struct(
    [("inst", pa.int64()), ("target", pa.int32()), ("median", pa.float64()), ("weight", pa.int64())]
)
_CANDIDATES = (
    "inst bigint, vals binary, times binary, "
    "proposals array<struct<inst: bigint, target: int, median: double, weight: bigint>>"
)


def _candidates(partials: DataFrame) -> DataFrame:
    """Partial results without the values in none of the open ranges; those that keep
    nothing are dropped.  With them the proposals: of each partial result the median of
    its candidates and their number, those of a batch reduced to their weighted medians
    and put into its first row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o = Open(b)
            i, j = o.place("low", True), o.place("high", False)
            live = np.flatnonzero(i < j)
            if not len(live):
                continue
            weight = o.upto[j[live]] - o.upto[i[live]]
            at = np.searchsorted(o.upto[1:], o.upto[i[live]] + (weight + 1) // 2)
            inst, target = o.inst[live], o.fields["target"][live]
            first, median, whole = weighted_medians([target, inst], o.v[at], weight)
            columns = [pa.array(c) for c in (inst[first], target[first], median, whole)]
            proposals = pa.StructArray.from_arrays(columns, fields=list(_PROPOSAL))
            step = np.zeros(len(o.v) + 1, np.int64)
            np.add.at(step, i[live], 1)
            np.add.at(step, j[live], -1)
            keep = np.cumsum(step[:-1]) > 0
            size = np.concatenate([[0], np.cumsum(keep)])[o.bounds]
            rows = np.flatnonzero(np.diff(size))
            ends = np.append(size[rows], size[-1]) * 8
            at_first = np.r_[0, np.full(len(rows), len(proposals))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b["inst"].take(pa.array(rows)),
                    runs.binaries(o.v[keep].view(np.uint8), ends),
                    runs.binaries(o.times[keep].view(np.uint8), ends),
                    pa.ListArray.from_arrays(pa.array(at_first), proposals),
                ],
                names=["inst", "vals", "times", "proposals"],
            )

    return partials.mapInArrow(kernel, _CANDIDATES)


PIVOT_PARTS = 64


def _pivots(proposals: DataFrame) -> DataFrame:
    """A pivot for each open range: the weighted median of the proposals, in two levels.
    The first takes the medians of up to PIVOT_PARTS parts, so no task holds all
    proposals of an instance; a quarter of the candidates at least lie on either side."""
    part = F.pmod(F.xxhash64("median", "weight"), F.lit(PIVOT_PARTS))
    first = _median_of(proposals.withColumn("part", part), ["inst", "target", "part"])
    return _median_of(first, ["inst", "target"]).select("inst", "target", F.col("median").alias("pivot"))


def _median_of(proposals: DataFrame, group: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy("median").rowsBetween(Window.unboundedPreceding, 0)
    below = proposals.withColumns({"upto": F.sum("weight").over(w), "whole": F.sum("weight").over(Window.partitionBy(*group))})
    reached = below.where(F.col("upto") * 2 >= F.col("whole"))
    return reached.groupBy(*group).agg(F.min("median").alias("median"), F.first("whole").alias("weight"))


def _counts(partials: DataFrame) -> DataFrame:
    """Candidates below and at the pivot in each partial result."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o = Open(b)
            i, j, k = o.place("low", True), o.place("pivot", False), o.place("pivot", True)
            less, equal = o.upto[j] - o.upto[i], o.upto[k] - o.upto[j]
            columns = [o.inst, o.fields["target"], less, equal]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    schema = pa.schema([("inst", pa.int64()), ("target", pa.int32()), ("less", pa.int64()), ("equal", pa.int64())])
    return partials.mapInArrow(kernel, "inst bigint, target int, less bigint, equal bigint")


def _leftovers(partials: DataFrame) -> DataFrame:
    """The candidates that are left, one row for each partial result and open range."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o = Open(b)
            i, j = o.place("low", True), o.place("high", False)
            live = np.flatnonzero(i < j)
            size = (j - i)[live]
            ends = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(i[live] - ends[:-1], size) + np.arange(int(ends[-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(o.inst[live]),
                    pa.array(o.fields["target"][live]),
                    pa.array(o.fields["rank"][live]),
                    runs.binaries(o.v[at].view(np.uint8), ends * 8),
                    runs.binaries(o.times[at].view(np.uint8), ends * 8),
                ],
                names=["inst", "target", "rank", "vals", "times"],
            )

    return partials.mapInArrow(kernel, "inst bigint, target int, rank bigint, vals binary, times binary")


def _last(leftovers: DataFrame) -> DataFrame:
    """The value at the rank among the candidates that are left."""

    def kernel(table: pa.Table) -> pa.Table:
        v, times, _ = _values(table)
        _, v, times = frequencies(np.zeros(len(v), np.int64), v, times)
        at = np.searchsorted(np.cumsum(times), table["rank"][0].as_py())
        return table.select(["inst", "target"]).slice(0, 1).append_column("found", pa.array([v[at]]))

    return leftovers.groupBy("inst", "target").applyInArrow(kernel, "inst bigint, target int, found double")


def _edges(partials: DataFrame) -> DataFrame:
    """Negative infinite and finite values of each instance."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, times, run = _values(pa.Table.from_batches([b]))
            sums = [np.bincount(run[m], times[m], b.num_rows).astype(np.int64) for m in (np.isneginf(v), np.isfinite(v))]
            yield pa.RecordBatch.from_arrays([b["inst"], *map(pa.array, sums)], names=["inst", "n_low", "n_mid"])

    found = partials.mapInArrow(kernel, "inst bigint, n_low bigint, n_mid bigint")
    return found.groupBy("inst").agg(F.sum("n_low").alias("n_low"), F.sum("n_mid").alias("n_mid"))


def _attach(partials: DataFrame, rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Partial results with the open ranges (at most five) of their instance, one of n."""
    opened = rows.groupBy("inst").agg(F.collect_list(F.struct(*columns)).alias("open"))
    # An instance and five ranges are some 200 bytes, so the count bounds the bytes.
    return join_small(partials, opened, ["inst"], n, "vals", fixed_width=True)


def select_large(partials: DataFrame, sizes: DataFrame, n: int, local_limit: int = LOCAL_LIMIT) -> DataFrame:
    """Percentiles of the n instances in ``sizes`` (instance, n), in rounds over all
    their partial results.  Returns one row for each instance and target.

    Each round reads only values that could still be a wanted one: those ruled out are
    discarded after it."""
    ids = cut(sizes.select(*INSTANCE, "n", F.monotonically_increasing_id().alias("inst")))
    rows = join_small(partials, ids.select(*INSTANCE, "inst"), INSTANCE, n, "vals").select("inst", "vals", "times")
    wanted = F.array(*[F.struct(F.lit(i).alias("target"), F.lit(p).alias("p")) for i, p in enumerate(PERMILLES)])
    # Infinite values lie outside the open range (-inf, inf): they are counted once.
    rank = F.expr("(n * t.p + 999) div 1000")
    state = (
        ids.select("inst", "n", F.explode(wanted).alias("t"))
        .join(_edges(rows), "inst")
        .select(
            "inst",
            F.col("t.target").alias("target"),
            (rank - F.col("n_low")).alias("rank"),
            F.when(rank <= F.col("n_low"), F.lit(float("-inf")))
            .when(rank > F.col("n_low") + F.col("n_mid"), F.lit(float("inf")))
            .alias("found"),
            F.lit(float("-inf")).alias("low"),
            F.lit(float("inf")).alias("high"),
            F.col("n_mid").alias("inside"),
        )
    )
    state = cut(state)
    while True:
        live = state.where(F.col("found").isNull())
        todo = live.where(F.col("inside") > local_limit)
        if todo.isEmpty():
            break
        rows = cut(_candidates(_attach(rows.select("inst", "vals", "times"), live, ["target", "low", "high"], n)))
        pivots = _pivots(rows.select(F.explode("proposals").alias("p")).select("p.*"))
        asked = cut(todo.join(pivots, ["inst", "target"]))
        counted = (
            _counts(_attach(rows.select("inst", "vals", "times"), asked, ["target", "low", "pivot"], n))
            .groupBy("inst", "target")
            .agg(F.sum("less").alias("less"), F.sum("equal").alias("equal"))
        )
        moved = asked.join(counted, ["inst", "target"])
        upto = F.col("less") + F.col("equal")
        is_low, is_at = F.col("rank") <= F.col("less"), F.col("rank") <= upto
        step = moved.select(
            "inst",
            "target",
            F.when(is_low | is_at, F.col("rank")).otherwise(F.col("rank") - upto).alias("rank"),
            F.when(~is_low & is_at, F.col("pivot")).alias("found"),
            F.when(is_low | is_at, F.col("low")).otherwise(F.col("pivot")).alias("low"),
            F.when(is_low, F.col("pivot")).otherwise(F.col("high")).alias("high"),
            F.when(is_low, F.col("less")).otherwise(F.col("inside") - upto).alias("inside"),
        )
        done = state.where(F.col("found").isNotNull() | (F.col("inside") <= local_limit))
        state = cut(done.select(step.columns).unionByName(step))
    last = _last(_leftovers(_attach(rows, state.where(F.col("found").isNull()), ["target", "low", "high", "rank"], n)))
    columns = ["inst", "target", "found"]
    picked = state.where(F.col("found").isNotNull()).select(columns).unionByName(last.select(columns))
    return picked.join(ids, "inst").select(*INSTANCE, "target", "found")


def percentiles(partials: DataFrame, local_limit: int = LOCAL_LIMIT) -> DataFrame:
    """Percentiles by plan, group and day and over all days (on_day ``all``):
    (plan_id, by_key, on_day, n_values, p50, p90, p95, p99, p999, rank_error)."""
    partials = cut(partials)
    sizes = partials.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("n_values").alias("held"))
    large = cut(sizes.where(F.col("held") > local_limit))
    n_large = large.count()
    if not n_large:
        found = _small(partials, daily_only=False)
    else:
        keys = large.select(*KEY, F.lit(True).alias("is_large"))
        marked = join_small(partials, keys, KEY, n_large, "vals", "left")
        small = _small(marked.where("is_large is null").drop("is_large"), daily_only=False)
        hot = cut(marked.where("is_large").drop("is_large"))
        days = cut(hot.groupBy(*INSTANCE).agg(F.sum("n").alias("n"), F.sum("n_values").alias("held")))
        large_days = days.where(F.col("held") > local_limit).select(*INSTANCE, "n")
        n_days = large_days.count()
        split = join_small(
            hot, large_days.select(*INSTANCE, F.lit(True).alias("large_day")), INSTANCE, n_days, "vals", "left"
        )
        one_task = _small(split.where("large_day is null").drop("large_day"), daily_only=True)
        sizes = large.select(*KEY, F.lit(ALL).alias("on_day"), "n").unionByName(large_days)
        over_all = hot.withColumn("on_day", F.lit(ALL))
        both = over_all.unionByName(split.where("large_day").drop("large_day"))
        picked = select_large(both, sizes, n_large + n_days, local_limit)
        wide = picked.groupBy(*INSTANCE).agg(
            *[F.max(F.when(F.col("target") == i, F.col("found"))).alias(x) for i, x in enumerate(NAMES)]
        )
        found = small.unionByName(one_task).unionByName(wide.join(sizes, INSTANCE).select(small.columns))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("on_day")), "yyyy-MM-dd")
    return found.select(
        "plan_id",
        F.array_join(F.transform("by_values", lambda v: F.coalesce(v, F.lit("<null>"))), "|").alias("by_key"),
        F.when(F.col("on_day") == ALL, F.lit("all")).otherwise(day).alias("on_day"),
        F.col("n").alias("n_values"),
        *NAMES,
        F.lit(0).alias("rank_error"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
