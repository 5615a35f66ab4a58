"""Cutting the lineage of iterative operators by tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: With it Spark removes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: With it a task may write several folders at once, so rows need not be sorted by folder first.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_written: WeakKeyDictionary[DataFrame, tuple[SparkSession, str]] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, as in tests, local sessions get a folder of
    their own; a cluster has no folder that could be guessed."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone when Python exits
        pass


@contextlib.contextmanager
def while_writing(spark: SparkSession):
    """Within it, what a query shuffles goes when it ends; nothing reads it again, as each query here ends in a table."""
    own = {CLEANUP: "true", WRITERS: "16"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Sending tables to all: the limit for what is estimated, and for what was shuffled and so is known.
SENT, SENT_KNOWN = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
SURE = 256 << 10  # estimated bytes that are few whatever the estimate is worth


def _bytes(text: str) -> int:
    n, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]?)[a-z]*\s*", text.lower()).groups()
    return int(n) << 10 * "bkmgtp".index(unit or "b")


@contextlib.contextmanager
def sent_by_size(spark: SparkSession):
    """Within it, a table goes to all executors, and so through the driver, by its size when it was shuffled, up to the session's limit.

    Before that Spark has estimates from files, and a column of ids of a wide table of names that repeat may be estimated at a
    hundredth of what it takes: of these only up to SURE bytes count. Tables that are marked to be sent still are."""
    before = {k: spark.conf.get(k, None) for k in (SENT, SENT_KNOWN)}
    limit = spark.conf.get(SENT)
    if before[SENT_KNOWN] is None:
        spark.conf.set(SENT_KNOWN, limit)
    spark.conf.set(SENT, str(min(_bytes(limit), SURE)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, codec: str = "snappy", file_rows: int = 0, by: str | None = None) -> DataFrame:
    """df as a table written to the shared folder: later jobs read the same rows, whatever executor is lost.

    The table goes by `drop`, or when the driver's Python ends. file_rows: rows in a file at most (0: any number). by: a
    column of a few values, each of which gets a folder, so that later jobs read what they ask for.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{uuid.uuid4().hex}"
    schema = df.schema
    with while_writing(spark):
        df.write.option("compression", codec).option("maxRecordsPerFile", file_rows).parquet(path, partitionBy=by)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    _written[out] = (spark, path)
    return out


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df as `materialise` writes it, and its number of rows, counted while they are written."""
    seen = Observation()
    table = materialise(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, seen.get["n"]


def drop(*tables: DataFrame) -> None:
    """Remove tables that `materialise` wrote and that no later job reads."""
    for table in tables:
        if table in _written:
            _remove(*_written.pop(table))
