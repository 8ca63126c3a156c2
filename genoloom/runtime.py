"""Session, table access, written intermediates and dense row numbers.

Intermediates that several jobs read are written as Parquet below the folder in
``spark.checkpoint.dir``, which all executors share, so that the loss of an executor costs
nothing but the tasks it ran. Nothing here keeps data in executor memory or on executor disks.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that count as spaces around names: Unicode White_Space and the ASCII separators.
SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

_written: "weakref.WeakKeyDictionary[SparkSession, set[str]]" = weakref.WeakKeyDictionary()


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("genoloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset in a local session (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="genoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, paths in list(_written.items()):
        for path in list(paths):
            try:
                _delete(spark, path)
            except Exception:  # the session may be gone already
                return


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once into the shared folder and return the scan of it: the lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._genoloom_path = path
    return out


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is deleted when Python ends."""
    path = f"{shared_dir(spark)}/genoloom-{uuid.uuid4().hex}"
    _written.setdefault(spark, set()).add(path)
    return path


def release(*frames: DataFrame) -> None:
    """Delete written intermediates that no plan reads any more."""
    for df in frames:
        path = getattr(df, "_genoloom_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written.get(df.sparkSession, set()).discard(path)


def dense_ids(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Number the rows start, start + 1, ... without one global sort.

    The rows are written once; what comes to the driver is one count for each partition.
    The result's ``_genoloom_rows`` is the number of rows.
    """
    spark = df.sparkSession
    raw = materialize(df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    counts = sorted((r["_pid"], r["n"]) for r in raw.groupBy("_pid").agg(F.count("*").alias("n")).collect())
    at, offsets = start, []
    for pid, n in counts:
        offsets.append((pid, at))
        at += n
    if not offsets:
        out = raw.select(*df.columns, F.lit(start).cast("long").alias(name))
        out._genoloom_rows = 0
        return out
    table = spark.createDataFrame(offsets, "_pid int, _at long")
    # one row for each partition of the written table: bounded by the partition count
    out = raw.join(F.broadcast(table), "_pid").select(
        *df.columns, (F.col("_at") + F.col("_mid").bitwiseAND((1 << 33) - 1)).alias(name)
    )
    out._genoloom_path, out._genoloom_rows = raw._genoloom_path, at - start
    return out


def running_totals(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group that come before by ``order`` (unique in a group).

    A range sort spreads a group over many tasks; each part sums its own rows, and only the parts'
    totals (one row for each part and group) meet in one window a group.
    """
    parts = df.repartitionByRange(F.col(group), F.col(order)).withColumn("_pid", F.spark_partition_id())
    parts = materialize(parts)
    before = lambda w: F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = parts.groupBy(group, "_pid").agg(F.sum(value).alias("_v"))
    base = totals.select(group, "_pid", before(Window.partitionBy(group).orderBy("_pid")).alias("_base"))
    own = parts.withColumn("_v", F.col(value)).withColumn("_own", before(Window.partitionBy(group, "_pid").orderBy(order)))
    return own.join(base, [group, "_pid"]).select(*df.columns, (F.col("_base") + F.col("_own")).alias(name))


def clean_name(column: Column | str) -> Column:
    """A name without spaces of any kind around it; null when nothing is left."""
    c = F.trim(F.col(column) if isinstance(column, str) else column, F.lit(SPACES))
    return F.nullif(c, F.lit(""))


def clean_gene(column: Column | str) -> Column:
    return F.upper(clean_name(column))


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def pick(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the named columns, so that extra or clashing ones never reach a join."""
    return df.select(*columns)
