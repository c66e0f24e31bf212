"""Session helpers shared by operators that need more than one job."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared folder (spark.checkpoint.dir); only a local session
    without one gets a folder of its own.

    Checkpoints belong to the application: a subfolder made here is deleted when the
    driver's Python ends.  Spark deletes single ones earlier, once their DataFrames are
    gone, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "tsq-checkpoints")
    sc.setCheckpointDir(shared)  # makes a subfolder of a new name
    _delete_at_exit(spark, sc._jsc.sc().getCheckpointDir().get())


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this application when the driver's Python ends."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def delete() -> None:
        try:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        except Exception:  # the JVM may be gone by then
            pass

    atexit.register(delete)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that a query writes and reads;
    deleted when the driver's Python ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def literal_columns(df: DataFrame) -> list[Column]:
    """The columns of a one-row DataFrame as literals.

    The row keeps Spark's binary layout, so an array of a hundred thousand values is
    one compact object that is shipped with the task and read by offset.  Only for
    tables whose size is bounded by a parameter."""
    jvm = df.sparkSession._jvm
    plan = df._jdf.queryExecution().executedPlan()
    rows = plan.executeCollect()
    if len(rows) != 1:
        raise ValueError(f"expected one row, got {len(rows)}")
    types = df._jdf.queryExecution().analyzed().schema()
    out = []
    for i in range(len(df.columns)):
        kind = types.apply(i).dataType()
        value = rows[0].get(i, kind)
        literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(value, kind)
        out.append(Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal)))
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    from pyspark.sql import functions as F

    return F.get(F.transform(F.array(value), body), F.lit(0))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where its input has fewer splits than there are cores (one
    small file, say); larger inputs stay as they are and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores, key) if splits < cores else df


SMALL_ROWS = 50_000
SMALL_BYTES = 32 << 20
SALTS = 64


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether a table of so many counted rows may be broadcast: at most SMALL_ROWS rows
    and SMALL_BYTES bytes, the bytes counted from its values."""
    from pyspark.sql import functions as F

    if rows > SMALL_ROWS:
        return False
    size = F.length(F.to_csv(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)])))
    return (df.agg(F.sum(size)).first()[0] or 0) <= SMALL_BYTES


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    n_small: int,
    spread: str,
    how: str = "inner",
    fixed_width: bool = False,
) -> DataFrame:
    """``big`` joined with ``small``, of which ``n_small`` rows were counted; with
    ``fixed_width`` their bytes are bounded by the count.

    A small side within SMALL_ROWS and SMALL_BYTES is broadcast, so a hot key of the big
    side stays where it is.  Beyond, the small side is repeated for SALTS salts and the
    big side spread over them by a hash of its column ``spread``."""
    from pyspark.sql import functions as F

    if n_small <= SMALL_ROWS and (fixed_width or is_small(small, n_small)):
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        .join(salted, [*on, "_salt"], how)
        .drop("_salt")
    )
