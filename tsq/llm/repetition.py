"""Repetition inside a single document (p8).

Tokeniser fertility: the words of a document are encoded with a public vocabulary, which
gives letters per token, the share of tokens that are bare bytes of a character (byte
fallback), and the token entropy, of single tokens and of runs of ``RUN_TOKENS`` tokens.
What the entropy of runs lacks to its greatest value (all runs different) is the run
deficit: where a share r of the runs has been met before, it is at least 2 r.

Each script has bands of these measures: the median of its documents and ``WIDTH``
robust deviations on both sides (the high edge of the run deficit within fixed bounds, so
neither a script without any repetition nor one of repetitions only loses its edge).
Documents above the band of their script's run deficit are rejected, and only they are
checked exactly: every run of five words (twelve characters in unspaced scripts; a word
weighs as much as 2.4 characters in mixed text) that begins like a run met before marks
its words as repeated, and the share is that of their letters.  Five words are at least
five tokens, so each repeated passage shows in the run deficit.

Words are letters and digits; case, punctuation, spacing, combining and invisible
characters are dropped, and a number counts as one word whatever its digits.

Defined results: NULL, empty and blank texts and texts without letters have share 0;
loops count from the place where a run begins again; each row gives one row; rows with
one doc_id are checked together.  ``found`` runs jobs when it is called.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsq.llm import vocab
from tsq.plans.session import SMALL_ROWS, cut

LIMIT = 1 / 3
# A run is complete at 60 points: five words of 12 or twelve characters of 5.
RUN, WORD, CHARACTER = 60, 12, 5
RUN_TOKENS = 5
KEPT_WORDS = 200_000  # encoded words a task remembers
BATCH_CHARACTERS = 1 << 22  # of the texts measured at once
WIDTH = 5.0
DEFICIT_EDGE = (0.25, 0.5)  # least and greatest high edge of the run deficit
STEPS = 256  # measures are counted in steps of 1 / STEPS for the bands
# Scripts written without spaces (Han, kana, Thai, Lao, Khmer, Myanmar).
UNSPACED = (
    "⺀-⿟々-〇〡-〩〱-〵぀-ヿㇰ-ㇿ㐀-䶿一-鿿"
    "豈-﫿ｦ-ﾟ฀-໿က-႟ក-៿\U00020000-\U0003ffff"
)
SCRIPTS = (
    ("latin", 0x41, 0x24F),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F),
)
MEASURES = ("letters_per_token", "fallback_share", "token_entropy", "run_deficit")
SCHEMA = "doc_id bigint, script string, n_letters bigint, n_tokens bigint, " + ", ".join(f"{m} double" for m in MEASURES)


NAMES = (*(name for name, _, _ in SCRIPTS), "unspaced", "other")
_UNSPACED = re.compile(f"[{UNSPACED}]$")


def script_of(word: str) -> int:
    """Place in NAMES of the script of a word's first character."""
    c = ord(word[0])
    for k, (_, low, high) in enumerate(SCRIPTS):
        if low <= c <= high:
            return k
    return len(SCRIPTS) + (not _UNSPACED.match(word))


def splitter():
    """A function from a text to its units: words, single characters of unspaced
    scripts, and "0" for numbers."""
    import regex

    dropped = regex.compile(r"[\p{Cf}\p{M}[\p{Cc}--[\t-\r]]]+", regex.V1)
    dropped_ascii = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]+")
    number = re.compile(r"\d+(?:[.,:/\-]\d+)*")
    # A letter spoilt by a false charset is two characters, the second often a sign,
    # which must not cut the word.
    spoilt = "[\u00c2-\u00df][\u00a0-\u00bf]"
    unit = re.compile(f"[{UNSPACED}]|(?:{spoilt}|[^\\W_{UNSPACED}])+")
    special = re.compile(f"[{UNSPACED}]|{spoilt}")
    plain, plain_ascii = re.compile(r"[^\W_]+"), re.compile("[a-z0-9]+")

    def units(text: str) -> list[str]:
        if text.isascii():
            return plain_ascii.findall(number.sub("0", dropped_ascii.sub("", text)).lower())
        clean = number.sub("0", dropped.sub("", text))
        found = (unit if special.search(clean) else plain).findall(clean)
        return "\n".join(found).lower().split("\n") if found else []

    return units


def repeated(ids: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Mask of the units that lie in a run met before.  Runs are compared by a 64-bit
    polynomial hash of their unit ids."""
    n = len(ids)
    out = np.zeros(n, bool)
    ends = np.concatenate([[0], np.cumsum(points)])
    stop = np.searchsorted(ends, ends[:-1] + RUN)
    whole = int(np.searchsorted(stop, n, side="right"))
    if whole < 2:
        return out
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        base, inverse = _powers(n + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * base[:n])])
        start = np.arange(whole)
        run = (prefix[stop[:whole]] - prefix[:whole]) * inverse[:whole] + stop[:whole].astype(np.uint64) - start.astype(
            np.uint64
        )
    _, first, back = np.unique(run, return_index=True, return_inverse=True)
    again = first[back] < start
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, start[again], 1)
    np.add.at(marks, stop[:whole][again], -1)
    return np.cumsum(marks[:n]) > 0


_BASE = 0x9E3779B97F4A7C15
_known: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if "base" not in _known or len(_known["base"]) < n:
        size = max(n, 4096) * 2
        for name, x in (("base", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, x, np.uint64)
            step[0] = 1
            with np.errstate(over="ignore"):
                _known[name] = np.multiply.accumulate(step)
    return _known["base"], _known["inverse"]


class Fertility:
    """What a vocabulary makes of words: their token ids, letters, script and points.
    Remembers a bounded number of them; a word is known by its place in the arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        import public_tokenizers

        self.encoding = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        size = max(ranks.values()) + 1
        self.begins, self.is_fallback = np.zeros(size, bool), np.zeros(size, bool)
        for piece, rank in ranks.items():
            self.begins[rank] = piece[:1] == b" "
            try:
                piece.decode()
            except UnicodeDecodeError:
                self.is_fallback[rank] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.words = np.zeros((5, 1 << 16), np.int64)  # first token, tokens, letters, script, points
        self.tokens, self.n_tokens = np.zeros(1 << 17, np.int64), 0

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word; all places of one call hold together."""
        got = list(map(self.known.get, words))
        if None in got:
            new = list(dict.fromkeys(w for w, i in zip(words, got) if i is None))
            if len(self.known) + len(new) > KEPT_WORDS:
                self._forget()
                new = list(dict.fromkeys(words))
            self._learn(new)
            got = list(map(self.known.get, words))
        return np.array(got, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(words)), np.int64)
        start = np.flatnonzero(self.begins[ids])
        script = np.array([script_of(w) for w in words], np.int64)
        a, e = len(self.known), len(self.known) + len(words)
        while e > self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        while self.n_tokens + len(ids) > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
        self.tokens[self.n_tokens : self.n_tokens + len(ids)] = ids
        self.words[:, a:e] = (
            start + self.n_tokens,
            np.diff(np.append(start, len(ids))),
            [sum(map(str.isalpha, w)) for w in words],
            script,
            np.where(script == NAMES.index("unspaced"), CHARACTER, WORD),
        )
        self.n_tokens += len(ids)
        self.known.update(zip(words, range(a, e)))


def _excess(doc: np.ndarray, key: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of its keys (less than 2**43) and the mean of
    log2 of how often each occurs: what its entropy lacks to the logarithm of the
    number."""
    order = np.sort((doc.astype(np.uint64) << np.uint64(43)) | key.astype(np.uint64))
    at = np.flatnonzero(np.r_[True, order[1:] != order[:-1]][: len(order)])
    count = np.diff(np.r_[at, len(order)]).astype(float)
    owner = (order[at] >> np.uint64(43)).astype(np.int64)
    n = np.bincount(doc, minlength=n_docs)
    return n, np.bincount(owner, count * np.log2(count), n_docs) / np.maximum(n, 1)


def measure(texts: list[str | None], units, fertility: Fertility, share: bool = False) -> dict[str, np.ndarray]:
    """The columns of SCHEMA but doc_id (with ``share`` also repeated_share) of several
    documents."""
    words = [units(t) if t else [] for t in texts]
    n, size = len(texts), np.array([len(w) for w in words], np.int64)
    place = fertility.places(list(chain.from_iterable(words)))
    doc = np.repeat(np.arange(n), size)
    first, n_pieces, letters, script, points = fertility.words[:, place]
    # Letters by document and script.
    by_script = np.bincount(doc * len(NAMES) + script, letters, n * len(NAMES)).reshape(n, len(NAMES))
    n_letters = by_script.sum(axis=1).astype(np.int64)
    ends = np.cumsum(n_pieces)
    at = np.repeat(first - (ends - n_pieces), n_pieces) + np.arange(int(n_pieces.sum()))
    tokens, token_doc = fertility.tokens[at], np.repeat(doc, n_pieces)
    n_tokens, excess = _excess(token_doc, tokens, n)
    run = np.zeros(max(len(tokens) - RUN_TOKENS + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(RUN_TOKENS):
            run = (run + tokens[k : k + len(run)].astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
            run ^= run >> np.uint64(29)
    inside = token_doc[: len(run)] == token_doc[len(tokens) - len(run) :]
    _, deficit = _excess(token_doc[: len(run)][inside], run[inside] >> np.uint64(21), n)
    live = n_letters > 0
    whole = np.maximum(n_tokens, 1)
    out = {
        "script": np.where(live, np.array([*NAMES, "none"], object)[by_script.argmax(axis=1)], "none"),
        "n_letters": n_letters,
        "n_tokens": np.where(live, n_tokens, 0),
        "letters_per_token": n_letters / whole,
        "fallback_share": np.where(live, np.bincount(token_doc, fertility.is_fallback[tokens], n) / whole, 0.0),
        "token_entropy": np.where(live, np.log2(whole) - excess, 0.0),
        "run_deficit": np.where(live, deficit, 0.0),
    }
    if share:
        stop = np.cumsum(size)
        again = np.zeros(n)
        for i in np.flatnonzero(live):
            own = slice(int(stop[i] - size[i]), int(stop[i]))
            again[i] = letters[own][repeated(place[own], points[own])].sum()
        out["repeated_share"] = again / np.maximum(n_letters, 1)
    return out


def measured(docs: DataFrame, share: bool = True, path: str = vocab.DEFAULT_VOCAB) -> DataFrame:
    """Fertility and (with ``share``) repeated share of each document (doc_id, text).
    The vocabulary (a fixed half megabyte) is broadcast."""
    ranks = docs.sparkSession.sparkContext.broadcast(vocab.load_ranks(path))
    schema = SCHEMA + (", repeated_share double" if share else "")
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility, units = Fertility(ranks.value), splitter()
        for b in batches:
            for part in _parts(b):
                columns = measure(part["text"].to_pylist(), units, fertility, share)
                arrays = [pa.array(columns[n], k) for n, k in fields[1:]]
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), *arrays], names=[n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most BATCH_CHARACTERS bytes, or of one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy())
    begin = 0
    while begin < batch.num_rows:
        before = size[begin - 1] if begin else 0
        end = max(int(np.searchsorted(size, before + BATCH_CHARACTERS, "right")), begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end


def bands(measures: DataFrame, width: float = WIDTH) -> DataFrame:
    """The usual range of the measures in each script: (script, n_docs, and for each
    measure its low and high edge).

    Medians come from counts by steps of 1 / STEPS, reduced before the shuffle, so each
    is within half a step of a median of the documents; a script has at most some
    thousand steps a measure, whatever the number of documents."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * STEPS).cast("int").alias("step")) for m in MEASURES])
    counts = (
        measures.select("script", F.explode(cells).alias("c"))
        .groupBy("script", "c.measure", "c.step")
        .agg(F.count("*").alias("n"))
    )
    group = ["script", "measure"]

    def middle(table: DataFrame, name: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy(*group).orderBy("step"))
        whole = F.sum("n").over(Window.partitionBy(*group))
        ranked = table.withColumns({"upto": upto, "whole": whole}).where("upto * 2 >= whole")
        return ranked.groupBy(*group).agg(F.min("step").alias(name), F.first("whole").alias("n_docs"))

    mid = middle(counts, "mid")
    away = counts.join(mid.drop("n_docs"), group).withColumn("step", F.abs(F.col("step") - F.col("mid")))
    away = away.groupBy(*group, "step").agg(F.sum("n").alias("n"))
    found = mid.join(middle(away, "mad").drop("n_docs"), group)
    reach = F.col("mad") * (1.4826 * width)
    low, high = (F.col("mid") - reach) / STEPS, (F.col("mid") + reach) / STEPS
    edges = []
    for m in MEASURES:
        top = F.least(F.greatest(high, F.lit(DEFICIT_EDGE[0])), F.lit(DEFICIT_EDGE[1])) if m == "run_deficit" else high
        edges.append(F.max(F.when(F.col("measure") == m, low)).alias(f"{m}_low"))
        edges.append(F.max(F.when(F.col("measure") == m, top)).alias(f"{m}_high"))
    return found.groupBy("script").agg(F.max("n_docs").alias("n_docs"), *edges)


def rejected(measures: DataFrame, edges: DataFrame) -> DataFrame:
    """Measures of the documents above the band of their script's run deficit.  There
    are at most as many bands as scripts (NAMES)."""
    high = edges.select("script", F.col("run_deficit_high").alias("_high"))
    return measures.join(F.broadcast(high), "script").where(F.col("run_deficit") > F.col("_high")).drop("_high")


def found(docs: DataFrame, limit: float = LIMIT, path: str = vocab.DEFAULT_VOCAB) -> DataFrame:
    """Documents of which more than ``limit`` is repeated: bands of all documents
    first, then the exact share of those that the bands reject."""
    measures = cut(measured(docs, False, path))
    suspects = cut(rejected(measures, bands(measures)).select(F.col("doc_id").alias("_suspect")).distinct())
    few = F.broadcast(suspects) if suspects.count() <= SMALL_ROWS else suspects
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    checked = texts.join(few, F.col("doc_id").eqNullSafe(F.col("_suspect")), "left_semi")
    return measured(checked, True, path).where(F.col("repeated_share") > limit).select("doc_id")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
