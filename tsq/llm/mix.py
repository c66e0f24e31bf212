"""Mixing sources to target weights (p7).

Tokens are summed per source, each source gets a repetition rate, and each document is
emitted floor(rate) times plus one more copy with a probability equal to the fraction,
drawn from a hash of document and mix: the same input gives the same mix on any
cluster, and no document waits for another.

The size of a mix is ``total_tokens``, by default the tokens of all its sources.  A
source's rate is target_share * size / tokens, at most max_repeats; a source held back
by max_repeats (or without documents) leaves its tokens out: the report has them as its
shortfall, next to the shares of the tokens really emitted and the greatest size of the
mix at which no source is held back.

Defined results: sources are compared without case and outer blanks; NULL text has 0
tokens and its document is emitted like others; documents of unlisted or NULL sources
are left out; a listed source without documents has a row with zeros; a source listed
twice in a mix counts with its first row by share; an empty table gives zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.llm import encode, vocab
from tsq.plans.session import cut

# Fixed value: the blanks stripped from a source, as Unicode white space.
_BLANKS = f"^[{vocab.SPACE}]+|[{vocab.SPACE}]+$"


def source_name(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, _BLANKS, ""))


def character_sizes(docs: DataFrame, size: str = "n_chars") -> DataFrame:
    """(doc_id, source, n_tokens) by a column of stored sizes instead of tokens."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("int")
    return docs.select("doc_id", source_name(F.col("source")).alias("source"), n.alias("n_tokens"))


def document_sizes(docs: DataFrame, path: str = vocab.DEFAULT_VOCAB) -> DataFrame:
    """(doc_id, source, n_tokens): encoded once, then kept in the shared folder."""
    tokens = encode.encode(docs.select("doc_id", "source", "text"), path=path)
    sized = tokens.select("doc_id", source_name(F.col("source")).alias("source"), F.size("ids").alias("n_tokens"))
    return cut(sized)


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, n_docs, source_tokens, rate,
    shortfall, uncapped_size): one row for each row of ``targets``, a fixed table of a
    few rows."""
    first = Window.partitionBy("mix_name", "source").orderBy(F.desc("target_share"), "max_repeats")
    wanted = (
        targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
        .withColumn("place", F.row_number().over(first))
        .where("place = 1")
        .drop("place")
    )
    totals = sizes.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("n_tokens").cast("long")).alias("source_tokens")
    )
    known = wanted.join(totals, "source", "left").fillna(0, ["n_docs", "source_tokens"])
    everything = F.sum("source_tokens").over(Window.partitionBy("mix_name"))
    size = F.lit(float(total_tokens)) if total_tokens is not None else everything.cast("double")
    rate = F.when(
        F.col("source_tokens") > 0, F.least(F.col("target_share") * size / F.col("source_tokens"), F.col("max_repeats"))
    ).otherwise(F.lit(0.0))
    # Whole where the cap holds; the least over a mix's sources is a size without cap.
    most = F.col("max_repeats") * F.col("source_tokens") / F.col("target_share")
    return known.withColumns(
        {
            "rate": rate,
            "shortfall": F.greatest(F.col("target_share") * size - rate * F.col("source_tokens"), F.lit(0.0)),
            "uncapped_size": F.min(F.when(F.col("target_share") > 0, most)).over(Window.partitionBy("mix_name")),
        }
    )


def copies(rate: Column, *seed: Column) -> Column:
    """floor(rate), plus one with a probability of the fraction by 52 bits of the MD5 of
    the seed's texts, joined by ``|``."""
    digest = F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in seed])), 1, 13)
    chance = F.conv(digest, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def emitted(sizes: DataFrame, rated: DataFrame) -> DataFrame:
    """(mix_name, doc_id, source, n_tokens, copies) of every document with a copy."""
    chosen = sizes.join(F.broadcast(rated.select("mix_name", "source", "rate")), "source")
    counted = chosen.withColumn("copies", copies(F.col("rate"), F.col("mix_name"), F.col("doc_id")))
    return counted.where("copies > 0").select("mix_name", "doc_id", "source", "n_tokens", "copies")


def mix(sizes: DataFrame, rated: DataFrame) -> DataFrame:
    """(mix_name, doc_id, copy_no, source, n_tokens): one row for each copy."""
    return emitted(sizes, rated).select(
        "mix_name", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "source", "n_tokens"
    )


def shares(sizes: DataFrame, rated: DataFrame) -> DataFrame:
    """The report: one row for each mix and listed source."""
    out = emitted(sizes, rated)
    sums = out.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("mix_tokens"),
        F.sum("copies").alias("mix_docs"),
        F.max("copies").alias("most_repeats"),
    )
    known = rated.join(F.broadcast(sums), ["mix_name", "source"], "left").fillna(
        0, ["mix_tokens", "mix_docs", "most_repeats"]
    )
    whole = F.sum("mix_tokens").over(Window.partitionBy("mix_name"))
    return known.select(
        "mix_name",
        "source",
        "n_docs",
        "source_tokens",
        "target_share",
        "max_repeats",
        "rate",
        "shortfall",
        "uncapped_size",
        "most_repeats",
        "mix_docs",
        "mix_tokens",
        F.when(whole > 0, F.col("mix_tokens") / whole).otherwise(F.lit(0.0)).alias("actual_share"),
    )
