"""Session helpers: test sessions and reliable lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one only where none is set, as in tests on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset, as in
    tests on one machine, a temporary folder is used. Never a local checkpoint: executors may be lost.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder; it is deleted when the Python process ends."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete_written)
    _written.append(path)
    return path


def stage_table(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a written table in the checkpoint folder, for wide or repetitive rows.

    It is deleted when the Python process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def _delete_written() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _written:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A table that is broadcast has at most so many bytes.
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and ``size`` bytes, else as it is, for a shuffled join.

    ``df`` should be cheap to read, such as a staged one. Rows and bytes are counted where they are.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def width(f: T.StructField):
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(f.name), F.lit(0)) + 8
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) + 16
        return F.lit(8)

    each = sum((width(f) for f in df.schema.fields), F.lit(0)).cast("long")
    n, total = df.agg(F.count("*"), F.sum(each)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df
