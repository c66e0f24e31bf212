"""Encoding of a corpus with a public byte-level BPE vocabulary, in the JVM.

Words are cut out by the vocabulary's pattern.  A word is encoded by a fold over its
bytes: the neighbouring pair of lowest rank merges, leftmost first, until no pair has
a rank.  Ranks come from a literal table (``vocab.pair_table``).

Words repeat, so a first pass counts the words of the whole corpus, the most frequent
ones (at most ``hot_words``, a bound on driver and task memory) are folded once each
into a literal dictionary, and the second pass looks every word up there; a word that
is not in the dictionary is folded where it stands.  Both ways give the same ids, so
the dictionary's size changes the time only.  No text is shuffled, only word counts.

Defined results: NULL and empty texts give an empty list; strings that look like
special tokens are ordinary text; every row gives one row, repeated ids included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.llm import vocab
from tsq.plans.session import cut, let, literal_columns

NO_RANK = vocab.PAIR_BASE
AT_ONCE = 64  # ids of a unit from which on all pairs of a rank merge at once
HOT_WORDS = 1 << 18
HOT_SLOTS = 1 << 20
LONGEST_HOT = 48  # characters of a dictionary word: bounds the dictionary's bytes
_tables: dict[tuple[str, str], list[Column]] = {}


class Codec:
    """Columns that encode and decode with one vocabulary (fixed tables of a few MB)."""

    def __init__(self, spark: SparkSession, path: str = vocab.DEFAULT_VOCAB):
        key = (spark.sparkContext.applicationId, path)
        if not vocab.merges_in_order(path):
            raise ValueError(f"{path}: some piece isn't reached by merges of rising rank")
        if key not in _tables:
            _tables[key] = self._literals(spark, path)
        self.offsets, self.slots, self.bytes, self.joinable, self.pieces = _tables[key]

    @staticmethod
    def _literals(spark: SparkSession, path: str) -> list[Column]:
        import pyarrow as pa

        offsets, slots = vocab.pair_table(path)
        table = pa.table(
            {
                "offsets": pa.array([offsets.astype("int32")], pa.list_(pa.int32())),
                "slots": pa.array([slots], pa.list_(pa.int64())),
                "bytes": pa.array([vocab.byte_ids(path)], pa.list_(pa.int32())),
                "joinable": pa.array([list(vocab.joinable(path))], pa.list_(pa.int8())),
                "pieces": pa.array([[p.decode("latin-1") for p in vocab.pieces(path)]], pa.list_(pa.string())),
            }
        )
        return literal_columns(spark.createDataFrame(table))

    def rank(self, a: Column, b: Column) -> Column:
        """Id of the union of two ids; NO_RANK or more where there is none."""
        return F.get(self.slots, F.get(self.offsets, a) + b).bitwiseXOR(F.shiftleft(a.cast("long"), 16))

    def _item(self, a: Column, b: Column, place: Column) -> Column:
        """A token a before b at a place as one number: its rank with b, the place, a.
        So the least item is the leftmost of those of the least rank."""
        rank = F.least(self.rank(a, b), F.lit(NO_RANK).cast("long"))
        return F.shiftleft(rank, 46).bitwiseOR(F.shiftleft(place.cast("long"), 17)).bitwiseOR(a.cast("long"))

    def _items(self, ids: Column) -> Column:
        """Items of ids; nothing joins with the last."""
        inner = F.transform(F.slice(ids, 1, F.size(ids) - 1), lambda a, i: self._item(a, F.get(ids, i + 1), i))
        return F.concat(inner, F.array(_last(F.element_at(ids, -1), F.size(ids) - 1)))

    def _merge_one(self, items: Column, least: Column) -> Column:
        """The pair of the least item merged; only the ranks beside it change."""

        def merge(p: Column) -> Column:
            new, place = _rank(least).cast("int"), _place(least)
            after, before = F.get(items, p + 1), F.get(items, p - 2)
            joined = F.when(after.isNull(), _last(new, place)).otherwise(self._item(new, _id(after), place))
            head = F.concat(F.slice(items, 1, p - 2), F.array(self._item(_id(before), new, _place(before)), joined))
            return F.concat(F.when(p > 1, head).otherwise(F.array(joined)), F.slice(items, p + 2, F.size(items)))

        return let(F.array_position(items, least).cast("int"), merge)

    def _merge_all(self, items: Column, least: Column) -> Column:
        """Every pair of the least rank merged in one pass, from the left.  Of pairs
        that overlap (a letter repeated) every other one merges."""
        new = _rank(least).cast("int")
        ids = F.transform(items, _id)
        hits = F.filter(F.transform(items, lambda e, i: F.when(_rank(e) == new, i)), lambda i: i.isNotNull())

        def every_other(h: Column) -> Column:
            first = F.filter(h, lambda x, k: (k == 0) | (F.get(h, k - 1) != x - 1))
            last = F.filter(h, lambda x, k: F.coalesce(F.get(h, k + 1) != x + 1, F.lit(True)))
            return let(last, lambda e: F.flatten(F.transform(first, lambda x, j: F.sequence(x, F.get(e, j), F.lit(2)))))

        def merged(m: Column, old: Column) -> Column:
            def upto(p: Column, k: Column) -> Column:
                free = F.when(k == 0, F.lit(0)).otherwise(F.get(m, k - 1) + 2)
                return F.concat(F.slice(old, free + 1, p - free), F.array(new))

            return F.concat(F.flatten(F.transform(m, upto)), F.slice(old, F.element_at(m, -1) + 3, F.size(old)))

        return let(let(ids, lambda old: let(let(hits, every_other), lambda m: merged(m, old))), self._items)

    def fold(self, unit: Column) -> Column:
        """Ids of an array of byte ids (not empty): ranked merges, lowest first.

        A merge never makes a pair of its own or a lower rank (``vocab.merges_in_order``),
        so all pairs of the least rank may merge in the same round.  Long units do so,
        which keeps a round linear; short ones merge the leftmost."""

        def step(items: Column, _: Column) -> Column:
            def merge(least: Column) -> Column:
                several = F.when(F.size(items) > AT_ONCE, self._merge_all(items, least))
                return F.when(_rank(least) < NO_RANK, several.otherwise(self._merge_one(items, least))).otherwise(items)

            return let(F.array_min(items), merge)

        rounds = F.sequence(F.lit(1), F.greatest(F.size(unit) - 1, F.lit(1)))
        return F.aggregate(rounds, self._items(unit), step, lambda items: F.transform(items, _id))

    def encode_word(self, word: Column) -> Column:
        """Ids of one word: cut into units no merge can cross, each unit folded."""
        # One character for each byte, its code point the byte.
        bytewise = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")

        def units(raw: Column) -> Column:
            n = F.size(raw)

            def cuts(at: Column) -> Column:
                return F.flatten(
                    F.transform(
                        at,
                        lambda start, i: let(
                            F.coalesce(F.get(at, i + 1), n) - start,
                            lambda m: F.when(m == 1, F.array(self._byte(F.get(raw, start)))).otherwise(
                                let(
                                    F.transform(F.slice(raw, start + 1, m), self._byte),
                                    self.fold,
                                )
                            ),
                        ),
                    )
                )

            starts = F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda i: (i == 0)
                | (F.get(self.joinable, F.get(raw, i - 1) * 256 + F.get(raw, i)) == F.lit(0).cast("tinyint")),
            )
            return let(starts, cuts)

        raw = F.transform(bytewise, F.ascii)
        return F.when(F.length(word) > 0, let(raw, units)).otherwise(_ints())

    def _byte(self, b: Column) -> Column:
        return F.get(self.bytes, b)

    def decode(self, ids: Column) -> Column:
        """Text of a list of ids: the binary pieces are concatenated, then read as
        UTF-8.  NULL gives NULL, an empty list an empty text."""
        joined = F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), "")
        return F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8")


def _ints() -> Column:
    return F.array().cast("array<int>")


def _last(a: Column, place: Column) -> Column:
    item = F.shiftleft(place.cast("long"), 17).bitwiseOR(a.cast("long"))
    return F.lit(NO_RANK << 46).bitwiseOR(item)


def _rank(item: Column) -> Column:
    return F.shiftright(item, 46)


def _place(item: Column) -> Column:
    return F.shiftright(item, 17).bitwiseAND(F.lit((1 << 29) - 1))


def _id(item: Column) -> Column:
    return item.bitwiseAND(F.lit((1 << 17) - 1)).cast("int")


def words(text: Column) -> Column:
    """The words of a text by the vocabulary's pattern, none for NULL."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(vocab.PRETOKEN), F.lit(0)), F.array().cast("array<string>"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts; counted before and after the shuffle."""
    return docs.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


class Dictionary:
    """The most frequent words of a corpus and their ids, as literals."""

    def __init__(self, docs: DataFrame, codec: Codec, text: str = "text", hot_words: int = HOT_WORDS):
        spark = docs.sparkSession
        counts = cut(
            word_counts(docs, text).where((F.col("n") > 1) & (F.length("word") <= LONGEST_HOT))
        )
        # The least count that keeps the dictionary within its bound, from a histogram
        # of counts on a log scale (at most a few hundred rows).
        level = F.floor(F.log2(F.col("n").cast("double")) * 8)
        room, least = hot_words, None
        for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
            if row["count"] > room:
                break
            room, least = room - row["count"], row["level"]
        hot = counts.where(level >= least) if least is not None else counts.limit(0)
        slot = F.pmod(F.xxhash64("word"), F.lit(HOT_SLOTS)).cast("int")
        found = (
            hot.repartition(max(1, spark.sparkContext.defaultParallelism), "word")
            .select("word", "n", slot.alias("slot"), codec.encode_word(F.col("word")).alias("ids"))
            .toArrow()
        )
        self.size = found.num_rows
        self.words, self.ids = literal_columns(spark.createDataFrame(self._packed(found)))

    @staticmethod
    def _packed(found):
        """One word for each slot, the more frequent one; the other is folded in place."""
        import numpy as np
        import pyarrow as pa

        found = found.sort_by([("n", "ascending"), ("word", "descending")])
        slots = np.full(HOT_SLOTS, -1, np.int32)
        slots[found["slot"].to_numpy()] = np.arange(found.num_rows, dtype=np.int32)
        at = pa.array(slots, mask=slots < 0)
        whole = pa.array([0, HOT_SLOTS], pa.int32())
        columns = {c: found[c].combine_chunks().take(at) for c in ("word", "ids")}
        return pa.table({c: pa.ListArray.from_arrays(whole, v) for c, v in columns.items()})

    def ids_of(self, word: Column, codec: Codec) -> Column:
        at = F.pmod(F.xxhash64(word), F.lit(HOT_SLOTS)).cast("int")
        return F.when(F.get(self.words, at) == word, F.get(self.ids, at)).otherwise(codec.encode_word(word))


def encode(
    docs: DataFrame,
    text: str = "text",
    ids: str = "ids",
    path: str = vocab.DEFAULT_VOCAB,
    hot_words: int = HOT_WORDS,
) -> DataFrame:
    """``docs`` with a column of token ids (array<int>) added or replaced.  Counts the
    words of ``docs`` in a job of its own when it is called."""
    codec = Codec(docs.sparkSession, path)
    hot = Dictionary(docs.select(text), codec, text, hot_words)
    return docs.withColumn(ids, F.flatten(F.transform(words(F.col(text)), lambda w: hot.ids_of(w, codec))))


def decode(tokens: DataFrame, ids: str = "ids", text: str = "text", path: str = vocab.DEFAULT_VOCAB) -> DataFrame:
    """``tokens`` with the decoded text added or replaced."""
    return tokens.withColumn(text, Codec(tokens.sparkSession, path).decode(F.col(ids)))
