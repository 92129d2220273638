"""Session helpers: shared storage for cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side is refused above this many rows (at most a few hundred bytes each).
BROADCAST_ROWS = 500_000


# Folders made inside the innermost ``intermediates`` scopes of this driver.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A cluster has to name one. Only a local session, as in tests, gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docvault-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A new folder for a table; it goes with the innermost scope, or with the scope around that."""
    path = f"{shared_folder(spark)}/docvault/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES[:-1][-1:] if outer else _SCOPES[-1:]:
        scope.append(path)
    return path


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's full address. Without a scheme it is on Spark's default file system, which only the driver is sure to know."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def arrow_files(folder: str):
    """Arrow's file system and path of a folder with its scheme, as ``qualified`` gave it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(f"file://{folder[5:]}" if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Let rows go to Python in batches of bounded bytes, since texts vary in length; a session that sets a bound keeps its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, size)


def remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Remove all tables that are materialised inside, at the end. Results must have been written elsewhere by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for name in _SCOPES.pop():
            remove(spark, name)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job inside has ended, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result is scanned several times: the lineage is cut at files that outlive an executor,
    and later scans prune columns. With ``keep`` the table outlives the innermost ``intermediates`` scope.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name, outer=keep)
    with _shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a materialised table before its scope ends; nothing may read it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(table.sparkSession, folder)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on an input that few tasks would read, such as one file or one large row group; others stay as they are read.

    A file is cut by its bytes, but the task that holds the start of a row group gets all of it. Rows of each task come from the footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    per_task = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    most, total = per_task.agg(F.max("n"), F.sum("n")).first()
    if not total or most * cores <= 1.5 * total:
        return df
    return df.repartition(max(cores, df.rdd.getNumPartitions()), key)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salt: Column | None = None,
                salts: int = 32, fits: bool | None = None) -> DataFrame:
    """Equi-join a large table with a lookup side whose size is checked first.

    ``fits`` gives the outcome where the caller has already checked a table that bounds the lookup side.

    A side of proven size is broadcast, so the large table is not moved. A larger one is joined by
    shuffle; the large side is spread over ``salts`` sub-keys (``salt`` picks one from the row) and the
    lookup side repeated on each, so one hot key never lands in one task.
    """
    if is_small(small) if fits is None else fits:
        return big.join(F.broadcast(small), keys, how)
    if salt is None:
        return big.join(small, keys, how)
    left = big.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
