"""Shared storage, size-checked broadcasts and joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
LITERAL_ROWS = 1_000
BATCH_BYTES = 16 * 1024 * 1024

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder is used, and only on a local master: a
    machine-local folder on a cluster would be lost with its machine. It is removed when the program ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="scorewright-")
        atexit.register(shutil.rmtree, _local_folders[app], ignore_errors=True)
    return _local_folders[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so nothing is overwritten."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/scorewright/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage at a point that outlives any executor, and gives the table a known size. ``by``
    names columns that get folders of their own, so that reading one of their values reads no other.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Hand Python tasks at most ``most`` bytes at a time, so that long texts stay within their memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > most:
        spark.conf.set(name, str(most))


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A dimension given by the caller as Python rows, marked for broadcast.

    The row count is checked here, so the broadcast has a known bound. ``schema`` lists plain types.
    """
    if len(rows) > LITERAL_ROWS:
        raise ValueError(f"{len(rows)} literal rows; pass a DataFrame above {LITERAL_ROWS}")
    names = [field.split()[0] for field in schema.split(",")]
    kinds = [field.split()[1] for field in schema.split(",")]
    structs = [
        F.struct(*[F.lit(value).cast(kind).alias(name) for value, name, kind in zip(row, names, kinds)])
        for row in rows
    ]
    return F.broadcast(spark.range(1, numPartitions=1).select(F.inline(F.array(*structs))))


def _value_bytes(schema: T.StructType) -> Column:
    """About the size of a row in memory; nested values count as their JSON text."""
    size = F.lit(16 * len(schema.fields)).cast("bigint")
    for field in schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
    return size


def fits_broadcast(stored: DataFrame) -> bool:
    """Is a stored table below both broadcast bounds? Counts its rows and their bytes in memory.

    The size of its files would not do: repeated values take next to nothing there.
    """
    found = stored.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_value_bytes(stored.schema)), F.lit(0)).alias("size")
    ).first()
    return found["n"] <= BROADCAST_ROWS and found["size"] <= BROADCAST_BYTES


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    *,
    spread: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
    stored: bool = False,
    may_broadcast: bool = True,
) -> DataFrame:
    """Join many facts to a table with one row, or few rows, per key.

    The table is written first, so its rows and bytes are known. Below both broadcast bounds it is
    broadcast and the facts do not move. Beyond, both sides are shuffled on the key. A key with more
    facts than a shuffle task has on average is spread over as many tasks as it would fill, by a salt
    taken from the ``spread`` columns; its table rows are repeated once per salt. All those repeats
    together are at most twice as many as there are shuffle partitions. Facts with a NULL key, which
    match nothing unless ``null_safe``, are spread over all tasks.

    Pass ``stored=True`` for a table that already lies in files, and ``may_broadcast=False`` for one
    that is wide (texts): it is then not written and not broadcast. The shuffled way reads the key
    columns of the facts twice, so facts that are costly to compute should be stored before.
    """
    kept = table if stored or not may_broadcast else materialize(table, "lookup")
    renamed = kept.withColumnsRenamed({key: f"_key_{key}" for key in on})

    def same(left: str, right: str):
        return F.col(left).eqNullSafe(F.col(right)) if null_safe else F.col(left) == F.col(right)

    matches = [same(key, f"_key_{key}") for key in on]
    if may_broadcast and fits_broadcast(kept):
        return facts.join(F.broadcast(renamed), matches, how).drop(*[f"_key_{key}" for key in on])

    uses = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_uses"))
    total = uses.agg(F.sum("_uses").alias("_total"))
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = F.col("_uses") * F.lit(tasks) / total.scalar()
    hot = uses.where(filled > 1)
    hot = materialize(hot.select(*[F.col(key).alias(f"_hot_{key}") for key in on], F.ceil(filled).alias("_salts")), "hot")
    zero = F.lit(0).cast("bigint")
    no_key = F.lit(False)
    for key in () if null_safe else on:
        no_key = no_key | F.col(key).isNull()
    salts = F.when(no_key, F.lit(tasks).cast("bigint")).otherwise(F.col("_salts"))
    salted = facts.join(F.broadcast(hot), [same(key, f"_hot_{key}") for key in on], "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(*spread), salts), zero)
    )
    repeated = renamed.join(F.broadcast(hot), [same(f"_key_{key}", f"_hot_{key}") for key in on], "left").withColumn(
        "_table_salt", F.explode(F.sequence(zero, F.coalesce(F.col("_salts") - 1, zero)))
    )
    helpers = ["_salts", *[f"_hot_{key}" for key in on]]
    joined = salted.drop(*helpers).join(
        repeated.drop(*helpers), [*matches, F.col("_salt") == F.col("_table_salt")], how
    )
    return joined.drop("_salt", "_table_salt", *[f"_key_{key}" for key in on])
