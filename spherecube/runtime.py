"""Session settings, lineage cuts and scratch paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch that Spark sends to a Python worker.
ARROW_BYTES = 4 << 20


def bound_arrow(spark: SparkSession) -> None:
    """Arrow batches of about ARROW_BYTES, for all operators alike.

    Spark's own limits are 10,000 rows and 64 MB, and each task holds several such batches outside the heap, where long
    texts or arrays would fill an executor's memory. The setting is the session's: there is none by operator.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tune(spark: SparkSession) -> SparkSession:
    """Adaptive execution with skew splitting, also where splitting costs one more shuffle.

    No operator hints a broadcast of data whose size it does not know: Spark broadcasts a side whose measured size is
    below `spark.sql.autoBroadcastJoinThreshold` and sort-merge joins the rest, splitting hot partitions. The session's
    time zone becomes UTC, in which the catalogue's dates are read.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    bound_arrow(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`; where it names none, one below the warehouse.

    A warehouse on a local disk is not shared by the machines of a cluster, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        scheme = warehouse.partition(":")[0] if ":" in warehouse else "file"
        if scheme == "file" and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; {warehouse} is a local one")
        named = f"{warehouse.rstrip('/')}/_stages"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of a row group of a stage's table: what each open writer holds in memory before it writes.
ROW_GROUP = 32 << 20


#: Stage tables this process has written and not removed.
_WRITTEN: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and go on from the table.

    For data several actions or several branches of a plan start from: none of them computes it again, each reads only
    the columns it needs, and a lost executor costs no more than a part of the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    _WRITTEN.append(path)
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def remove_stage(df: DataFrame) -> None:
    """Delete the table behind a frame that `materialise` returned, once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark).rstrip("/").partition(":")[2] or shared_dir(spark).rstrip("/")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/stage-" in folder and root.lstrip("/") in folder:
            _delete(spark, folder)
            _WRITTEN[:] = [p for p in _WRITTEN if p.rpartition("/")[2] != folder.rpartition("/")[2]]


def remove_stages(spark: SparkSession) -> int:
    """Delete all stage tables this process has written, and return their number.

    For the end of a session, or after the results of its queries are written: frames that start from the tables cannot be
    read any more.
    """
    removed = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return removed
