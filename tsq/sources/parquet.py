"""Metrics in Parquet files, and catalogs stored as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.catalog import Catalog, Table
from tsq.schema import ColumnDef, GridMeta, Index, MetricSchema
from tsq.timemath import Duration, Instant, micros

BLOOM_RATE = 0.01


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bloom_bits(elements: int, rate: float = BLOOM_RATE) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for so many elements."""
    import math

    bits = math.ceil(-elements * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, round(bits / elements * math.log(2)))


def index_options(schema: MetricSchema, distinct: dict[str, int] | None = None) -> dict[str, str]:
    """Write options for the index hints.

    Sparse labels get a Bloom filter per row group, and pages of at most their
    ``block_size`` rows, the blocks that the page index can skip.  Parquet writes a Bloom
    filter only where the column is not dictionary-encoded, so those columns do without
    a dictionary.  For inverted labels the dictionary and the min-max statistics serve."""
    options = {}
    for name, index in schema.index.items():
        if index.kind == "sparse":
            options[f"parquet.bloom.filter.enabled#{name}"] = "true"
            options[f"parquet.bloom.filter.fpp#{name}"] = str(BLOOM_RATE)
            options[f"parquet.enable.dictionary#{name}"] = "false"
            if distinct and distinct.get(name):
                options[f"parquet.bloom.filter.expected.ndv#{name}"] = str(distinct[name])
    blocks = [i.block_size for i in schema.index.values() if i.kind == "sparse" and i.block_size]
    if blocks:
        options["parquet.page.row.count.limit"] = str(min(blocks))
    return options


def distinct_values(table: Table) -> dict[str, int]:
    """About how many values each sparse label has: one row, counted before the shuffle."""
    sparse = [name for name, index in table.schema.index.items() if index.kind == "sparse"]
    if not sparse:
        return {}
    return table.df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in sparse]).first().asDict()


def write(
    table: Table,
    path: str,
    mode: str = "errorifexists",
    by_day: bool = False,
    distinct: dict[str, int] | None = None,
) -> None:
    """Writes a metric so that scans skip data: rows sorted within files by inverted
    labels and time, Bloom filters on sparse labels, one directory a day on request.

    With ``by_day`` rows are spread by day and a hash of the series, so a busy day is
    written by several tasks.  The Bloom filters are made for ``distinct`` values of each
    sparse label, counted first where not given."""
    distinct = distinct_values(table) if distinct is None else distinct
    inverted = [name for name, index in table.schema.index.items() if index.kind == "inverted"]
    df = table.df
    if by_day:
        day = F.col(table.time).cast("date")
        salt = F.pmod(F.xxhash64(*table.schema.label_names), F.lit(8))
        df = df.withColumn("on_day", day).repartition("on_day", salt)
    df = df.sortWithinPartitions(*(["on_day"] if by_day else []), *inverted, table.time)
    writer = df.write.mode(mode).options(**index_options(table.schema, distinct))
    (writer.partitionBy("on_day") if by_day else writer).parquet(path)


def load_catalog(
    spark: SparkSession, directory: str, catalog: Catalog | None = None, ties: dict[str, str] | None = None
) -> Catalog:
    """The metrics of a directory by its tables ``metric_catalog`` and
    ``metric_schema`` (a few rows each): resource, stored_as, form, grid, tags, columns."""
    out = catalog if catalog is not None else Catalog()
    columns = read(spark, f"{directory}/metric_schema.parquet").orderBy("ordinal").collect()
    entries = read(spark, f"{directory}/metric_catalog.parquet")
    start_ms = F.floor(micros(F.col("start_at"), entries.schema["start_at"].dataType) / 1000).alias("start_ms")
    for e in entries.select("*", start_ms).orderBy("resource").collect():
        own = [c for c in columns if c["resource"] == e["resource"]]
        role = lambda r: tuple(ColumnDef(c["column_name"], c["column_type"]) for c in own if c["column_role"] == r)
        index = {c["column_name"]: Index(c["index_kind"], c["block_size"]) for c in own if c["index_kind"]}
        packed = e["form"] == "packed"
        table = Table(
            e["resource"],
            read(spark, f"{directory}/{e['stored_as']}.parquet"),
            MetricSchema(role("label"), role("field"), index),
            GridMeta(Instant(e["start_ms"]), Duration(e["unit_ms"]), e["width"]),
            time="chunk_start" if packed else "ts",
            packed=packed,
            tie=None if packed else (ties or {}).get(e["resource"], "sample_id"),
        )
        out.create_table(table)
        out.tag(e["resource"], list(e["tags"] or []))
    return out
