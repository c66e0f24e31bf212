"""Implausible readings in packed series (p4): spikes, stuck stretches and impossible
values, each judged against the normal behaviour of its own series.

A series (full label tuple, NULL equal to NULL) is put in time order over all its
records and decomposed by undecimated Haar wavelets.

* Spikes: the spread of the details at scale 2 (by their median, so excursions do not
  widen it) is the usual scatter, taken as no smaller than the step the series is read
  in.  An excursion of w <= ``LONGEST`` samples is a pair of opposite details w apart,
  at the finest scale or at scale w, both beyond ``DETAIL`` times the limit; the medians
  of the samples around it then confirm that each of its samples lies beyond the limit.
  A gradual peak has no such pair and is no spike.
* Stuck stretches: runs of zero details, in a series that otherwise keeps changing.
* Impossible values: NaN, infinite or outside the limits of the quantity.

Records are sorted by series and time in one range partitioning, so a series may span
any number of tasks.  A series that lies inside one task is judged there.  Others are
cut into pieces of at most ``piece`` samples: all a sample's judgement needs is at most
``HALO`` samples on each side, which neighbouring pieces exchange, and totals of the
series, which are sums, least and greatest values and counts of details by size class
(1/256 of a power of two, in both ways).  The flags are the same wherever a series is cut.

Defined results: redelivered records give one row a slot; NULL slots and NULL values
are never flagged; a quantity without limits has none; a label that is NULL is a label
value; a series of fewer than twenty possible samples has no spikes; at the ends of a
series one detail makes an excursion; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.plans.session import cut, join_small

IMPOSSIBLE, SPIKE, STUCK = "impossible", "spike", "stuck"
SIDE = 10  # samples on each side that make the level
REACH = 24  # where they are looked for
LONGEST = 4
TIMES = 10.0
DETAIL = 0.4  # least detail of an excursion's edge, as a share of the limit
STUCK_RUN = 15
BUSY = 0.93  # share of changes from sample to sample of a series that keeps changing
MOST_STUCK = 0.5  # beyond this share of held values the series is one that rests
LEAST_SAMPLES = 20
HALO = 40  # REACH and the excursions that begin or end in it
PIECE = 1 << 18  # samples of one series that a task judges at once
BATCH = 1 << 19  # samples of several series that a task judges at once
CLASS_BITS = 44  # of a detail's 64 bits those left out of its size class


@dataclass
class Samples:
    """Samples of consecutive series (or of one with the samples around a piece):
    values, number of the series, and whether a sample is the first or last of it."""

    v: np.ndarray
    series: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, v: np.ndarray, series: np.ndarray, open_left: bool = False, open_right: bool = False) -> Samples:
        change = series[1:] != series[:-1]
        n = min(len(v), 1)
        left, right = np.full(n, not open_left), np.full(n, not open_right)
        return cls(v, series, np.concatenate([left, change]), np.concatenate([change, right]))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of equal neighbours begin, and the size of each sample's run; NaN
        equals nothing."""
        if not len(self.v):
            return np.zeros(0, bool), np.zeros(0, np.int64)
        new = self.begin.copy()
        new[0] = True
        new[1:] |= self.v[1:] != self.v[:-1]
        size = np.diff(np.r_[np.flatnonzero(new), len(new)])
        return new, np.repeat(size, size)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and last place of each sample's series."""
        at = np.flatnonzero(np.r_[True, self.series[1:] != self.series[:-1]][: len(self.v)])
        size = np.diff(np.r_[at, len(self.v)])
        return np.repeat(at, size), np.repeat(at + size - 1, size)

    def details(self, scale: int) -> np.ndarray:
        """Undecimated Haar details: the mean of ``scale`` samples from each sample on
        minus the mean of the ``scale`` samples before it; a series goes on at its ends
        with its last value."""
        n = len(self.v)
        first, last = self.bounds()
        out = np.zeros(n)
        inner = np.arange(scale, n - scale + 1) if n >= 2 * scale else np.zeros(0, np.int64)
        for k in range(scale):
            if len(inner):
                out[inner] += self.v[scale + k : n - scale + 1 + k] - self.v[scale - 1 - k : n - scale - k]
        edge = np.flatnonzero((np.arange(n) - first < scale) | (last - np.arange(n) < scale - 1))
        out[edge] = 0.0
        for k in range(scale):
            out[edge] += self.v[np.minimum(edge + k, last[edge])] - self.v[np.maximum(edge - 1 - k, first[edge])]
        return out / scale


def decimal_places(v: np.ndarray) -> np.ndarray:
    """Decimal places of each value, at most seven."""
    out, left = np.full(len(v), 7), np.arange(len(v))
    for places in range(7):
        x = v[left]
        whole = np.abs(x - np.round(x, places)) <= 1e-9 * np.maximum(1.0, np.abs(x))
        out[left[whole]] = places
        left = left[~whole]
    return out


# The totals of a series, and how those of its parts combine.
TOTALS = {
    "n_possible": "sum",
    "n_moving": "sum",
    "least_change": "min",
    "places": "max",
    "n_stored": "sum",
    "n_held": "sum",
    "n_resting": "sum",
    "n_changes": "sum",
}


def totals(possible: Samples, stored: Samples, own_p: np.ndarray, own_s: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """TOTALS of n series over the samples in the ``own`` masks."""

    def count(s: Samples, mask: np.ndarray) -> np.ndarray:
        return np.bincount(s.series[mask], minlength=n)

    new, size = possible.runs()
    lasting = size > LONGEST
    pair = np.flatnonzero(own_p[1:] & new[1:] & ~possible.begin[1:] & lasting[1:] & lasting[:-1]) + 1
    least = np.full(n, np.inf)
    np.minimum.at(least, possible.series[pair], np.abs(possible.v[pair] - possible.v[pair - 1]))
    places = np.zeros(n, np.int64)
    np.maximum.at(places, possible.series[own_p], decimal_places(possible.v[own_p]))
    fresh, length = stored.runs()
    held = length >= STUCK_RUN
    return {
        "n_possible": count(possible, own_p),
        "n_moving": count(possible, own_p & (size < STUCK_RUN)),
        "least_change": least,
        "places": places,
        "n_stored": count(stored, own_s),
        "n_held": count(stored, own_s & held),
        "n_resting": count(stored, own_s & held & ~fresh),
        "n_changes": count(stored, own_s & fresh & ~stored.begin),
    }


def detail_class(possible: Samples) -> np.ndarray:
    """The size class of each sample's detail at scale 2."""
    return np.abs(possible.details(2)).view(np.int64) >> CLASS_BITS


def middle_class(series: np.ndarray, cls: np.ndarray, n: int) -> np.ndarray:
    """The class of the (lower) median detail of each of n series."""
    shift = 64 - CLASS_BITS
    order = np.sort((series << shift) | cls)
    size = np.bincount(series, minlength=n)
    at = np.cumsum(size) - size + np.maximum(size - 1, 0) // 2
    out = np.zeros(n, np.int64)
    out[size > 0] = order[at[size > 0]] & ((1 << shift) - 1)
    return out


def rests(total: dict[str, np.ndarray]) -> np.ndarray:
    """Series of which stretches of one value are the normal behaviour."""
    return total["n_moving"] < MOST_STUCK * total["n_possible"]


def spike_limits(total: dict[str, np.ndarray], cls: np.ndarray, jump: np.ndarray, times: float = TIMES) -> np.ndarray:
    """How far from its level a sample of each series has to lie to be a spike."""
    scatter = 1.4826 * (cls << CLASS_BITS).view(np.float64)
    step = np.where(np.isfinite(total["least_change"]), total["least_change"], 10.0 ** -total["places"].astype(float))
    limit = np.where(np.isnan(jump), times * np.maximum(scatter, step), jump)
    return np.where(total["n_possible"] < LEAST_SAMPLES, np.inf, limit)


def spikes(s: Samples, limit: np.ndarray, detail: float = DETAIL) -> np.ndarray:
    """Mask of the samples of excursions beyond the limit (one for each sample)."""
    n = len(s.v)
    out, hot = np.zeros(n, bool), np.zeros(n, bool)
    if not n:
        return out
    first, last = s.bounds()
    fine = s.details(1)
    least = detail * limit
    found = []
    for w in range(1, min(LONGEST, n) + 1):
        coarse = s.details(w) if w > 1 else fine
        rise, fall = np.maximum(fine, coarse) > least, np.minimum(fine, coarse) < -least
        one = (first[w - 1 :] <= np.arange(n - w + 1)) & ~(s.begin[: n - w + 1] & s.end[w - 1 :])
        for sign, opens, closes in ((1.0, rise, fall), (-1.0, fall, rise)):
            shut = s.end[w - 1 :].copy()
            shut[: n - w] |= closes[w:] & (s.series[w:] == s.series[:-w])
            at = np.flatnonzero(one & shut & (opens | s.begin)[: n - w + 1])
            found.append((at, np.full(len(at), w), np.full(len(at), sign)))
            for k in range(w):
                hot[at + k] = True
    at, width, sign = (np.concatenate(x) for x in zip(*found))
    for i in range(0, len(at), 1 << 16):
        part = slice(i, i + (1 << 16))
        a, w, up = at[part], width[part], sign[part]
        ahead = np.arange(REACH)
        before, after = a[:, None] - 1 - ahead, (a + w)[:, None] + ahead
        levels = [
            _level(s.v, hot, before, before >= first[a][:, None]),
            _level(s.v, hot, after, after <= last[a][:, None]),
        ]

        def beyond(place: np.ndarray) -> np.ndarray:
            """Samples beyond the limit from the level on both sides, as far as known."""
            far = np.ones(len(a), bool)
            for level, known in levels:
                far &= ~known | (up * (s.v[np.clip(place, 0, n - 1)] - level) > limit[a])
            return far

        far = levels[0][1] | levels[1][1]
        for k in range(LONGEST):
            far &= (k >= w) | beyond(a + k)
        # An excursion ends where its samples end: one of five has no part of four.
        far &= (a == first[a]) | ~beyond(a - 1)
        far &= (a + w > last[a]) | ~beyond(a + w)
        for a_, w_ in zip(a[far], w[far]):
            out[a_ : a_ + w_] = True
    return out


def _level(v: np.ndarray, hot: np.ndarray, place: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The median of the nearest SIDE calm samples, and whether there are any."""
    place = np.clip(place, 0, len(v) - 1)
    calm = inside & ~hot[place]
    calm &= np.cumsum(calm, axis=1) <= SIDE
    ordered = np.sort(np.where(calm, v[place], np.inf), axis=1)[:, :SIDE]
    size = calm.sum(axis=1)
    row, high = np.arange(len(size)), np.maximum(size - 1, 0)
    with np.errstate(invalid="ignore"):
        middle = (ordered[row, high // 2] + ordered[row, (high + 1) // 2]) / 2
    return middle, size > 0


def stuck(s: Samples, total: dict[str, np.ndarray]) -> np.ndarray:
    """Mask of stretches of one value in series that otherwise keep changing."""
    steps = total["n_stored"] - 1 - total["n_resting"]
    sticks = (total["n_held"] <= MOST_STUCK * total["n_stored"]) & (total["n_changes"] >= BUSY * steps)
    _, length = s.runs()
    return (length >= STUCK_RUN) & sticks[s.series]


def impossible(x: np.ndarray, lower: np.ndarray | float, upper: np.ndarray | float) -> np.ndarray:
    """Mask of values that can't be; a limit that is NaN is none."""
    with np.errstate(invalid="ignore"):
        return ~np.isfinite(x) | (x < lower) | (x > upper)


def judge(
    x: np.ndarray,
    series: np.ndarray,
    bad: np.ndarray,
    jump: np.ndarray,
    times: float = TIMES,
    detail: float = DETAIL,
) -> dict[str, np.ndarray]:
    """Masks over all stored samples of whole series in order; ``jump`` has for each
    series the limit of its spikes, NaN where it comes from the scatter."""
    n = len(jump)
    stored = Samples.of(x, series)
    possible = Samples.of(x[~bad], series[~bad])
    total = totals(possible, stored, np.ones(len(possible.v), bool), np.ones(len(x), bool), n)
    _, size = possible.runs()
    usual = (size < STUCK_RUN) | rests(total)[possible.series]
    cls = middle_class(possible.series[usual], detail_class(possible)[usual], n)
    limit = spike_limits(total, cls, jump, times)
    spike = np.zeros(len(x), bool)
    spike[~bad] = spikes(possible, limit[possible.series], detail)
    return {IMPOSSIBLE: bad, SPIKE: spike, STUCK: stuck(stored, total)}


_FLAGS = [("record_id", pa.int64()), ("slot", pa.int32()), ("reason", pa.string())]
_PIECE_KEY = [("series", pa.string()), ("start", pa.int64()), ("record", pa.int64()), ("offset", pa.int32())]
_PIECE = [
    *_PIECE_KEY,
    ("lower", pa.float64()),
    ("upper", pa.float64()),
    ("jump", pa.float64()),
    ("samples", pa.binary()),
    ("records", pa.binary()),
    ("slots", pa.binary()),
    ("n_possible", pa.int64()),
    ("n_stored", pa.int64()),
    *[(f"{end}_{kind}", pa.list_(pa.float64())) for kind in ("possible", "stored") for end in ("head", "tail")],
]
_SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.binary(): "binary"}


def _ddl(fields) -> str:
    return ", ".join(f"`{n}` {_SQL.get(t, 'array<double>')}" for n, t in fields)


def _flat(col: pa.ChunkedArray) -> pa.Array:
    flat = col.combine_chunks()
    return flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat


def _numbers(col: pa.ChunkedArray) -> np.ndarray:
    return _flat(col).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


class Rows:
    """Records of a table in order of series and time, each once, as samples."""

    def __init__(self, table: pa.Table, jumps: dict[str, float]):
        self.table = table
        key = _flat(table["series"]).dictionary_encode()
        code = key.indices.to_numpy(zero_copy_only=False)
        self.starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        series = np.repeat(np.arange(len(self.starts)), np.diff(np.r_[self.starts, len(code)]))
        ids = table["record_id"].to_numpy()
        lists = _flat(table["value"])
        at = lists.offsets.to_numpy()
        stored = lists.values.is_valid().to_numpy(zero_copy_only=False)[at[0] : at[-1]]
        size = np.diff(at)
        again = np.r_[False, (ids[1:] == ids[:-1]) & (series[1:] == series[:-1])]
        stored &= np.repeat(~again, size)
        record = np.repeat(np.arange(len(ids)), size)[stored]
        self.record = record
        self.x = lists.values.fill_null(0.0).to_numpy(zero_copy_only=False)[at[0] : at[-1]][stored]
        self.slot = (np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], size))[stored].astype(np.int32)
        self.ids, self.time = ids[record], table["at"].to_numpy()[record]
        self.series = series[record]
        lower, upper = _numbers(table["lower_limit"]), _numbers(table["upper_limit"])
        self.bad = impossible(self.x, lower[record], upper[record])
        names = table["quantity"].take(pa.array(self.starts)).to_pylist()
        self.jump = np.array([jumps.get(q, np.nan) for q in names], float)
        self.lower, self.upper = lower[self.starts], upper[self.starts]

    def part(self, low: int, high: int) -> slice:
        """The samples of the series low <= i < high."""
        return slice(*np.searchsorted(self.series, [low, high]).tolist())

    def flags(self, low: int, high: int, settings: dict) -> Iterator[pa.RecordBatch]:
        """Flags of the series low <= i < high, which are whole."""
        p = self.part(low, high)
        masks = judge(self.x[p], self.series[p] - low, self.bad[p], self.jump[low:high], **settings)
        yield from flag_rows(self.ids[p], self.slot[p], masks)

    def pieces(self, i: int, piece: int) -> Iterator[pa.RecordBatch]:
        """The samples of series i in pieces of nearly the same size."""
        p = self.part(i, i + 1)
        n = p.stop - p.start
        name = self.table["series"][int(self.starts[i])].as_py()
        for q in np.array_split(np.arange(p.start, p.stop), -(-n // piece)) if n else ():
            x, good = self.x[q], self.x[q][~self.bad[q]]
            row = {
                "series": name,
                "start": int(self.time[q[0]]),
                "record": int(self.ids[q[0]]),
                "offset": int(self.slot[q[0]]),
                "lower": self.lower[i],
                "upper": self.upper[i],
                "jump": self.jump[i],
                "samples": x.tobytes(),
                "records": self.ids[q].tobytes(),
                "slots": self.slot[q].tobytes(),
                "n_possible": len(good),
                "n_stored": len(x),
                "head_possible": good[:HALO],
                "tail_possible": good[-HALO:],
                "head_stored": x[:HALO],
                "tail_stored": x[-HALO:],
            }
            empty = [pa.nulls(1, t) for _, t in _FLAGS]
            yield pa.RecordBatch.from_arrays([*empty, *[pa.array([row[n]], t) for n, t in _PIECE]], schema=_FIRST)


def flag_rows(ids: np.ndarray, slot: np.ndarray, masks: dict[str, np.ndarray], bare: bool = False):
    for reason, mask in masks.items():
        at = np.flatnonzero(mask)
        rows = [pa.array(ids[at]), pa.array(slot[at]), pa.array([reason], pa.string()).take(pa.array(np.zeros(len(at), int)))]
        if bare:
            yield pa.RecordBatch.from_arrays(rows, names=[n for n, _ in _FLAGS])
        else:
            yield pa.RecordBatch.from_arrays([*rows, *[pa.nulls(len(at), t) for _, t in _PIECE]], schema=_FIRST)


_FIRST = pa.schema([*_FLAGS, *_PIECE])


def _first_pass(ordered: DataFrame, jumps: dict[str, float], settings: dict, piece: int, batch: int) -> DataFrame:
    """Flags of the series that lie inside one task, pieces of all others: of the first
    and the last series of each task and of those longer than a piece."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, in_pieces, sent = 0, None, None

        def work(final: bool):
            nonlocal held, size, in_pieces, sent
            table = pa.Table.from_batches(held)
            if sent is not None:  # a redelivered record may come after its piece was sent
                again = 0
                while again < table.num_rows and (table["series"][again].as_py(), table["record_id"][again].as_py()) == sent:
                    again += 1
                table = table.slice(again)
            if not table.num_rows:
                held, size = [], 0
                return
            rows = Rows(table.combine_chunks(), jumps)
            last = len(rows.starts) - 1
            first_name = table["series"][0].as_py()
            in_pieces = first_name if in_pieces is None else in_pieces
            begin = 0
            if last > 0 and first_name == in_pieces:
                yield from rows.pieces(0, piece)
                begin = 1
            if begin < last:
                yield from rows.flags(begin, last, settings)
            rest = rows.part(last, last + 1)
            if final or rest.stop - rest.start > piece:
                yield from rows.pieces(last, piece)
                in_pieces = table["series"][-1].as_py()
                sent = (in_pieces, table["record_id"][-1].as_py())
                held, size = [], 0
            else:
                left = table.slice(int(rows.starts[last]))
                held, size = left.to_batches(), rest.stop - rest.start

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += len(b["value"].flatten())
                if size > batch:
                    yield from work(False)
        if held:
            yield from work(True)

    return ordered.mapInArrow(kernel, _ddl([*_FLAGS, *_PIECE]))


@dataclass
class Piece:
    """A piece with the samples around it."""

    possible: Samples
    stored: Samples
    own_p: np.ndarray
    own_s: np.ndarray
    bad: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Piece:
        x = np.frombuffer(row["samples"], np.float64)
        lower, upper = (np.nan if row[c] is None else row[c] for c in ("lower", "upper"))
        bad = impossible(x, lower, upper)
        out = []
        for kind, own in (("possible", x[~bad]), ("stored", x)):
            left, right = (np.array(row[f"{side}_{kind}"], float) for side in ("left", "right"))
            v = np.r_[left, own, right]
            mask = np.zeros(len(v), bool)
            mask[len(left) : len(left) + len(own)] = True
            out.append((Samples.of(v, np.zeros(len(v), np.int64), len(left) > 0, len(right) > 0), mask))
        return cls(out[0][0], out[1][0], out[0][1], out[1][1], bad)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _with_neighbours(pieces: DataFrame) -> DataFrame:
    """Pieces with the HALO samples before and after them in their series."""
    key = [n for n, _ in _PIECE_KEY]
    few = (F.col("n_possible") < HALO) | (F.col("n_stored") < HALO)
    # Only ends of partitions are that short: nearly always none or one a series.
    short = pieces.where(few).groupBy("series").count().agg(F.max("count")).first()[0] or 0
    order = Window.partitionBy("series").orderBy("start", "record", "offset")
    sides = {}
    for kind in ("possible", "stored"):
        before = F.flatten(F.collect_list(f"tail_{kind}").over(order.rowsBetween(-1 - short, -1)))
        after = F.flatten(F.collect_list(f"head_{kind}").over(order.rowsBetween(1, 1 + short)))
        sides[f"left_{kind}"] = F.slice(before, F.greatest(F.size(before) - HALO, F.lit(0)) + 1, F.lit(HALO))
        sides[f"right_{kind}"] = F.slice(after, 1, HALO)
    edges = pieces.select(*key, *[f"{e}_{k}" for k in ("possible", "stored") for e in ("head", "tail")])
    near = edges.select(*key, *[c.alias(n) for n, c in sides.items()])
    payload = pieces.select(*key, "lower", "upper", "jump", "samples", "records", "slots")
    return payload.join(near, key)


def _series_totals(pieces: DataFrame) -> DataFrame:
    """TOTALS and the median classes of the details of each series in pieces."""
    names = [("series", pa.string()), ("class", pa.int64()), ("n_all", pa.int64()), ("n_usual", pa.int64())]
    names += [(n, pa.float64()) for n in TOTALS]
    schema = pa.schema(names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            p = Piece.of(row)
            total = totals(p.possible, p.stored, p.own_p, p.own_s, 1)
            _, size = p.possible.runs()
            cls = detail_class(p.possible)[p.own_p]
            kinds, back = np.unique(cls, return_inverse=True)
            n_all = np.bincount(back, minlength=len(kinds))
            n_usual = np.bincount(back[size[p.own_p] < STUCK_RUN], minlength=len(kinds))
            k = len(kinds) + 1
            columns = [pa.array([row["series"]] * k, pa.string()), pa.array([*kinds.tolist(), None], pa.int64())]
            columns += [pa.array([*n.tolist(), None], pa.int64()) for n in (n_all, n_usual)]
            columns += [pa.array([None] * (k - 1) + [float(total[n][0])], pa.float64()) for n in TOTALS]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    found = pieces.mapInArrow(kernel, _ddl(names))
    combine = {"sum": F.sum, "min": F.min, "max": F.max}
    merged = found.groupBy("series", "class").agg(
        F.sum("n_all").alias("n_all"), F.sum("n_usual").alias("n_usual"), *[combine[c](n).alias(n) for n, c in TOTALS.items()]
    )
    order = Window.partitionBy("series").orderBy("class")
    whole = Window.partitionBy("series")
    upto = merged.withColumns({f"upto_{n}": F.sum(f"n_{n}").over(order) for n in ("all", "usual")}).withColumns(
        {f"whole_{n}": F.sum(f"n_{n}").over(whole) for n in ("all", "usual")}
    )

    def middle(n: str) -> Column:
        reached = F.col("class").isNotNull() & (F.col(f"upto_{n}") * 2 >= F.col(f"whole_{n}"))
        return F.coalesce(F.min(F.when(reached, F.col("class"))), F.lit(0)).alias(f"class_{n}")

    return upto.groupBy("series").agg(middle("all"), middle("usual"), *[F.max(n).alias(n) for n in TOTALS])


def _second_pass(pieces: DataFrame, settings: dict) -> DataFrame:
    """Flags of pieces with neighbours and totals."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            p = Piece.of(row)
            total = {n: np.array([row[n]]) for n in TOTALS}
            cls = np.array([row["class_all"] if rests(total)[0] else row["class_usual"]])
            jump = np.array([np.nan if row["jump"] is None else row["jump"]], float)
            limit = spike_limits(total, cls, jump, settings.get("times", TIMES))
            spike = spikes(p.possible, np.full(len(p.possible.v), limit[0]), settings.get("detail", DETAIL))
            own = np.zeros(len(p.bad), bool)
            own[~p.bad] = spike[p.own_p]
            masks = {IMPOSSIBLE: p.bad, SPIKE: own, STUCK: stuck(p.stored, total)[p.own_s]}
            ids = np.frombuffer(row["records"], np.int64)
            yield from flag_rows(ids, np.frombuffer(row["slots"], np.int32), masks, bare=True)

    return pieces.mapInArrow(kernel, _ddl(_FLAGS))


def flag(
    records: DataFrame,
    limits: DataFrame,
    labels: Sequence[str],
    jumps: dict[str, float] | None = None,
    times: float = TIMES,
    detail: float = DETAIL,
    piece: int = PIECE,
    batch: int = BATCH,
) -> DataFrame:
    """(record_id, slot, reason) of every implausible stored sample.

    ``limits`` has one row for each quantity.  ``jumps`` gives quantities whose spikes
    are counted from a fixed difference instead of the scatter.  ``piece`` and ``batch``
    bound a task's memory and change no flag."""
    bounds = limits.select("quantity", "lower_limit", "upper_limit").dropDuplicates(["quantity"])
    rows = records.where(F.exists("value", lambda v: v.isNotNull())).select(
        F.to_json(F.struct(*[F.col(c).alias(str(i)) for i, c in enumerate(labels)])).alias("series"),
        F.unix_timestamp(F.col("chunk_start").cast("timestamp")).alias("at"),
        "record_id",
        "quantity",
        "value",
    )
    joined = join_small(rows, bounds, ["quantity"], limits.count(), "record_id", "left")
    order = ("series", "at", "record_id")
    ordered = joined.repartitionByRange(*order).sortWithinPartitions(*order)
    settings = {"times": times, "detail": detail}
    first = cut(_first_pass(ordered, jumps or {}, settings, piece, batch))
    pieces = _with_neighbours(first.where("reason IS NULL").drop("record_id", "slot", "reason"))
    total = cut(_series_totals(pieces))
    known = join_small(pieces, total, ["series"], total.count(), "record", "inner")
    return first.where("reason IS NOT NULL").select(*[n for n, _ in _FLAGS]).unionByName(_second_pass(known, settings))


def found(flags: DataFrame) -> DataFrame:
    """One row for each flagged sample."""
    return flags.select("record_id", "slot").distinct()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
