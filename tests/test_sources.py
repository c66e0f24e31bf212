"""Files with index hints, stored catalogs and streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest

from tsq.catalog import Catalog, Table
from tsq.engine import Engine
from tsq.errors import Unsupported
from tsq.schema import GridMeta, Index, MetricSchema
from tsq.sources.memory import long_rows
from tsq.sources.parquet import bloom_bits, index_options, load_catalog, write
from tsq.streaming.selector import once_each, pull, read_stream, select_stream
from tsq.timemath import Duration, Instant

SCHEMA = MetricSchema.of(
    {"env": "string", "key": "string"}, {"value": "float64"}, {"env": Index("inverted"), "key": Index("sparse", 1000)}
)
GRID = GridMeta(Instant.of("2024-01-01"), Duration(60_000))


def table(spark, n=200):
    rows = [
        {"env": "ab"[i % 2], "key": f"k{i}", "ts": datetime(2024, 1, 1) + timedelta(hours=i), "value": float(i)}
        for i in range(n)
    ]
    return Table("m", long_rows(spark, SCHEMA, rows), SCHEMA, GRID)


def test_bloom_bounds():
    bits, hashes = bloom_bits(10_000_000)
    assert hashes <= 10 and bits / 8 <= 15_000_000


def test_written_metric_reads_back_and_has_hints(spark, tmp_path):
    t = table(spark)
    path = str(tmp_path / "m")
    write(t, path, by_day=True, distinct={"key": 1000})
    back = spark.read.parquet(path)
    columns = ["env", "key", "ts", "value"]
    assert sorted(back.select(columns).collect()) == sorted(t.df.select(columns).collect())
    file = next((tmp_path / "m").rglob("*.parquet"))
    meta = pq.ParquetFile(file).metadata.row_group(0)
    names = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert not any("DICTIONARY" in e for e in names["key"].encodings)
    assert "parquet.bloom.filter.enabled#key" in index_options(SCHEMA)
    assert index_options(SCHEMA)["parquet.page.row.count.limit"] == "1000"  # the block size of the sparse label
    assert names["env"].statistics.has_min_max


def test_skipping_never_drops_rows(spark, tmp_path):
    path = str(tmp_path / "m")
    write(table(spark), path)
    catalog = Catalog()
    catalog.create_table(Table("m", spark.read.parquet(path), SCHEMA, GRID))
    engine = Engine(spark, catalog)
    assert engine.scan("m", [("key", "!=", "k7")]).count() == 199
    assert engine.scan("m", [("key", "=", "k7")]).count() == 1
    assert engine.scan("m", [("key", "=", "never")]).count() == 0
    assert engine.scan("m", [("key", "!=", "never")]).count() == 200


def test_stored_catalog(spark, sf_dir):
    catalog = load_catalog(spark, sf_dir)
    assert catalog.tables_by_tag("edge") == ["edge.gateway.request_cost", "plant.probe.reading"]
    gauge = catalog.get("plant.probe.reading")
    assert gauge.packed and gauge.grid == GridMeta(Instant.of("2025-01-01"), Duration(60_000), 60)
    assert gauge.schema.label("probe_addr").type == "ipv6"
    assert gauge.schema.index["probe_addr"] == Index("sparse", 500)
    df = Engine(spark, catalog).scan(
        "edge.gateway.request_cost", [("client_addr", "!=", "10.0.0.1"), ("is_retry", "=", True)]
    )
    assert df.count() == catalog.get("edge.gateway.request_cost").df.where("is_retry").count()


def test_stream_selector(spark, tmp_path):
    t = table(spark)
    source = str(tmp_path / "in")
    t.df.union(t.df.limit(20)).write.parquet(source)
    stream = read_stream(spark, source, spark.read.parquet(source))
    catalog = Catalog()
    catalog.create_table(Table("m", once_each(stream, "ts", "key", "400 days"), SCHEMA, GRID))
    engine = Engine(spark, catalog)
    selected = select_stream(engine, 'm{env="a"}', at="2030-01-01")
    assert selected.isStreaming
    q = selected.writeStream.format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "c"))
    run = q.trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("got").count() == 100
    with pytest.raises(Unsupported):
        select_stream(engine, "rate(m)")


def test_pull(spark):
    assert sum(1 for _ in pull(table(spark).df)) == 200
