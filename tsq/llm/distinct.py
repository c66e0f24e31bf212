"""Distinct counts over huge identifier sets (p1).

An identifier becomes a 64-bit hash.  A partial result is a sorted run of hashes for one
cell (plan, UTC day, group), stored as varints of deltas.  Runs merge by a k-way union
whatever day, group or partition they come from: first the partial runs of each cell to
one run, then the runs of cells to those of every combination of labels and of all days,
and the counts are the lengths of merged runs.

A cell whose runs hold more than ``piece`` hashes together is cut into ranges of the hash
space, as many as its own size asks for, so no task holds a whole large cell and its
counts add up over the ranges.  All other cells stay whole, however many rows there are
in all, so their runs never get shorter and the coding keeps its worth.

Error: a count falls short by one for each pair of identifiers with one hash.  The
expected shortfall, and so the chance of any, is at most n (n - 1) / 2**65, given with
each count as ``error_bound``.

Defined results: NULL identifiers and rows without a time are left out; a group without
identifiers has no row; a missing label is a group of its own; repeated rows change
nothing; an empty table gives an empty result.  ``merge_runs`` and ``distinct_counts``
run jobs when they are called (sizes of cells).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsq.llm import runs
from tsq.operators.frequency import by_key, label_text
from tsq.plans.session import cut, join_small

PARTIAL = "plan_id int, on_day int, by_values array<string>, n bigint, run binary"
CELL = ["plan_id", "labels", "key", "on_day"]
RUN = [*CELL, "hash_range", "n", "run", "bits"]
PIECE = 1 << 18  # hashes of one cell that a task unites at once
BATCH = 1 << 18  # hashes of several cells that a task unites at once
SLICE = 1 << 16  # hashes that a task takes from a batch of runs at once
ALL = -(1 << 31)  # the day of a cell over all days
TWO_65 = float(1 << 65)


def partial_runs(rows: DataFrame, plans: list[dict], time: str) -> DataFrame:
    """Runs of each input partition.  A plan has plan_id, by (label columns, cast to
    string for the key) and field (the identifier's column)."""
    label = {c: f"label_{i}" for i, c in enumerate(sorted({c for p in plans for c in p["by"]}))}
    ident = {c: f"hash_{i}" for i, c in enumerate(sorted({p["field"] for p in plans}))}
    wanted = [F.datediff(F.col(time).cast("date"), F.lit("1970-01-01").cast("date")).alias("on_day")]
    wanted += [label_text(rows, c).alias(a) for c, a in label.items()]
    wanted += [F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(a) for c, a in ident.items()]
    specs = [(p["plan_id"], [label[c] for c in p["by"]], ident[p["field"]]) for p in plans]
    schema = pa.schema(
        [
            ("plan_id", pa.int32()),
            ("on_day", pa.int32()),
            ("by_values", pa.list_(pa.string())),
            ("n", pa.int64()),
            ("run", pa.binary()),
        ]
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs.tables(batches):
            for plan_id, by, field in specs:
                cell, first = runs.codes(table, ["on_day", *by])
                ids = runs._flat(table[field])
                live = ids.is_valid().to_numpy(zero_copy_only=False)
                h = ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)[live]
                yield from _runs(table, plan_id, by, cell[live], first, h)

    def _runs(table, plan_id, by, cell, first, h):
        order = np.lexsort((h, cell))
        cell, h = cell[order], h[order]
        keep = runs.starts_of(cell, h)
        cell, h = cell[keep], h[keep]
        at = runs.starts_of(cell)
        rows = first[cell[at]]
        yield from pa.table(
            [
                pa.array(np.full(len(at), plan_id, np.int32)),
                runs._flat(table["on_day"]).take(pa.array(rows)),
                runs.lists(table, by, rows),
                pa.array(np.diff(np.append(at, len(h)))),
                runs.pack(h, at),
            ],
            schema=schema,
        ).to_batches(max_chunksize=50_000)

    return rows.where(F.col(time).isNotNull()).select(*wanted).mapInArrow(kernel, PARTIAL)


def _key(values: Column) -> Column:
    """Label values as one text that no other values give."""
    return F.to_json(values)


def _large(cells: DataFrame, piece: int) -> DataFrame:
    """Cells of more than ``piece`` hashes and the bits of the hash that name their
    ranges.  ``cells`` has (CELL, n); the sizes are upper bounds, as runs may share
    hashes, so no range is larger than wanted."""
    sizes = cells.groupBy(*CELL).agg(F.sum("n").alias("n")).where(F.col("n") > piece)
    bits = F.ceil(F.log2(F.col("n") / F.lit(float(piece)))).cast("int").alias("bits")
    return cut(sizes.select(*CELL, bits))


def _in_ranges(parts: DataFrame, large: DataFrame) -> DataFrame:
    """Runs (CELL, hash_range, n, run) with those of large cells cut into the ranges of
    their cell; all others are passed on as they are."""
    n_large = large.count()
    if not n_large:
        return parts.withColumn("bits", F.lit(0))
    known = join_small(parts.drop("bits"), large, CELL, n_large, "run", "left").fillna(0, ["bits"])
    kind = "plan_id int, labels int, key string, on_day int, hash_range int, n bigint, run binary, bits int"
    whole = known.where("bits = 0").select(*RUN)
    return whole.unionByName(known.where("bits > 0").select(*RUN).mapInArrow(_range_kernel(), kind))


def _range_kernel():
    """Cuts runs (RUN) into the 2**bits ranges of their cells."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs.slices(batches, SLICE):
            table = pa.Table.from_batches([b])
            h, run = runs.unpack(table["run"])
            shift = (64 - table["bits"].to_numpy())[run].astype(np.uint64)
            part = (h >> shift).astype(np.int64)
            at = runs.starts_of(run, part)
            rows = pa.array(run[at])
            columns = {c: table[c].take(rows) for c in RUN if c not in ("hash_range", "n", "run")}
            columns |= {
                "hash_range": pa.array(part[at].astype(np.int32)),
                "n": pa.array(np.diff(np.append(at, len(h)))),
                "run": runs.pack(h, at),
            }
            yield from pa.table({c: columns[c] for c in RUN}).cast(_schema(RUN)).to_batches()

    return kernel


def _schema(names: list[str]) -> pa.Schema:
    kinds = {"key": pa.string(), "n": pa.int64(), "run": pa.binary()}
    return pa.schema([(c, kinds.get(c, pa.int32())) for c in names])


def _united(parts: DataFrame, with_runs: bool, batch: int) -> DataFrame:
    """One row for each cell and range: the k-way union of its runs, and its length."""
    keys = [*CELL, "hash_range"]
    kind = "plan_id int, labels int, key string, on_day int, hash_range int, bits int, n bigint"
    ordered = parts.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(_union_kernel(with_runs, batch), kind + (", run binary" if with_runs else ""))


def _union_kernel(with_runs: bool, batch: int):
    """Unites the runs of each cell and range, which follow each other.  It holds
    ``batch`` hashes and a slice at once, or one cell's range where that is more."""
    names = [*CELL, "hash_range", "bits", "n", *(["run"] if with_runs else [])]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in runs.slices(batches, min(batch, SLICE)):
            held.append(b)
            n += int(b["n"].to_numpy().sum())
            if n < batch:
                continue
            table = pa.Table.from_batches(held)
            last = int(runs.starts_of(*key_codes(table))[-1]) if table.num_rows else 0
            if last:  # the last cell may go on in the next batch
                yield from unite(table.slice(0, last))
            held = table.slice(last).to_batches()
            n = sum(int(x["n"].to_numpy().sum()) for x in held)
        if held:
            yield from unite(pa.Table.from_batches(held))

    def key_codes(table: pa.Table) -> list[np.ndarray]:
        key = runs._flat(table["key"]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        return [key, *[table[c].to_numpy() for c in ("plan_id", "labels", "on_day", "hash_range")]]

    def unite(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        first = runs.starts_of(*key_codes(table))
        size = np.diff(np.append(first, table.num_rows))
        # A cell of one run is that run.
        single = pa.array(first[size == 1])
        if len(single):
            yield from table.take(single).select(names).cast(schema).to_batches()
        many = np.repeat(size > 1, size)
        rest = table.filter(pa.array(many))
        if not rest.num_rows:
            return
        h, run = runs.unpack(rest["run"])
        cell = np.repeat(np.arange(len(size)), size)[many][run]
        cell, h = runs.union(cell, h)
        at = runs.starts_of(cell)
        rows = pa.array(first[cell[at]])
        columns = {c: table[c].take(rows) for c in names}
        columns["n"] = pa.array(np.diff(np.append(at, len(h))))
        if with_runs:
            columns["run"] = runs.pack(h, at)
        yield from pa.table(columns).cast(schema).to_batches()

    schema = _schema(names)
    return kernel


def merge_runs(partials: DataFrame, piece: int = PIECE, batch: int = BATCH) -> DataFrame:
    """One run for each plan, day, group and range: (plan_id, on_day, by_values, bits,
    hash_range, n, run).  The result is of the form of ``partials`` with more columns,
    so it can be united with others and merged again."""
    parts = cut(_cells(partials))
    merged = _united(_in_ranges(parts, _large(parts.select(*CELL, "n"), piece)), True, batch)
    return merged.select(
        "plan_id", "on_day", F.from_json("key", "array<string>").alias("by_values"), "bits", "hash_range", "n", "run"
    )


def _cells(partials: DataFrame) -> DataFrame:
    """Partial runs as runs of the finest cells, whole or cut as they come."""
    return partials.select(
        "plan_id",
        F.lit(-1).alias("labels"),
        _key(F.col("by_values")).alias("key"),
        "on_day",
        F.lit(0).alias("hash_range"),
        "n",
        "run",
    )


def _combinations(cells: DataFrame, plans: list[dict]) -> DataFrame:
    """Each row of the finest cells once for every combination of its plan's labels
    (``labels`` has their bits), by day and over all days, that it is part of, with
    ``finest`` true where that is its own cell."""
    values = F.from_json("key", "array<string>")
    of_plan = F.lit(None)
    for p in plans:
        k = len(p["by"])
        combos = []
        for mask in range(1 << k):
            kept = F.array(*[F.get(values, F.lit(i)) for i in range(k) if mask >> i & 1])
            # Parsed only where some labels are kept and some are not.
            key = F.lit("[]") if not mask else F.col("key") if mask + 1 == 1 << k else _key(kept)
            for day in (F.lit(ALL), F.col("on_day")):
                finest = F.lit(mask + 1 == 1 << k and len(combos) % 2 == 1)
                cell = F.struct(F.lit(mask).alias("labels"), key.alias("key"), day.alias("on_day"), finest.alias("finest"))
                combos.append(cell)
        of_plan = F.when(F.col("plan_id") == p["plan_id"], F.array(*combos)).otherwise(of_plan)
    rest = [c for c in cells.columns if c not in CELL]
    exploded = cells.select("plan_id", F.explode(of_plan).alias("c"), *rest)
    return exploded.select("plan_id", "c.*", *rest)


def distinct_counts(
    partials: DataFrame, plans: list[dict], piece: int = PIECE, batch: int = BATCH
) -> DataFrame:
    """Counts for every combination of a plan's labels, by day and over all days.

    (plan_id, by_labels, by_key, on_day, n_distinct, error_bound): by_labels are the
    labels of the combination joined by ``|``, by_key their values with ``<null>`` for
    a missing one, on_day is YYYY-MM-DD or ``all``."""
    parts = cut(_cells(partials))
    sizes = parts.groupBy(*CELL).agg(F.sum("n").alias("n"))
    coarse = _combinations(sizes, plans).where(~F.col("finest")).select(*CELL, "n")
    large = _large(sizes.unionByName(coarse), piece)
    merged = _united(_in_ranges(parts, large.where("labels < 0")), True, batch)
    # A cell's own count is the length of its merged run, so that run stays behind.  A
    # coarser cell is at least as large as its parts: what was cut before is cut into
    # the same ranges or finer ones.
    combined = _combinations(merged, plans).withColumn("run", F.when(~F.col("finest"), F.col("run")))
    counted = _united(_in_ranges(combined.drop("finest", "bits"), large.where("labels >= 0")), False, batch)
    cells = counted.groupBy(*CELL).agg(F.sum("n").alias("n"))
    names = F.lit(None).cast("string")
    for p in plans:
        for mask in range(1 << len(p["by"])):
            text = "|".join(c for i, c in enumerate(p["by"]) if mask >> i & 1)
            names = F.when((F.col("plan_id") == p["plan_id"]) & (F.col("labels") == mask), F.lit(text)).otherwise(names)
    n = F.col("n").cast("double")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("on_day")), "yyyy-MM-dd")
    return cells.select(
        "plan_id",
        names.alias("by_labels"),
        by_key(F.from_json("key", "array<string>")).alias("by_key"),
        F.when(F.col("on_day") == ALL, F.lit("all")).otherwise(day).alias("on_day"),
        F.col("n").alias("n_distinct"),
        (n * (n - 1) / F.lit(TWO_65)).alias("error_bound"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
