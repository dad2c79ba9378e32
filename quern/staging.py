"""Tables written between the steps of an operator, and checked-size broadcasts.

A staged table cuts lineage: what reads it survives the loss of executors, because the files lie in
the folder that the cluster names in ``spark.checkpoint.dir``. Only where that is unset (tests on one
machine) is a temporary folder made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables; a cluster that names none is an error, not a guess."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="quern-stage-")
    return f"file://{_own[app]}"


class Staged:
    """One written table. ``frame`` reads it; ``drop`` deletes the files early, the JVM's end does it at last."""

    def __init__(self, df: DataFrame, label: str, partition_by: tuple[str, ...] = ()):
        spark = df.sparkSession
        self._spark = spark
        self.path = f"{shared_folder(spark)}/quern-{label}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path)
        self.schema = df.schema
        path = self._jpath()
        self._fs(path).deleteOnExit(path)

    def _jpath(self):
        return self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)

    def _fs(self, path):
        return path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def frame(self) -> DataFrame:
        return self._spark.read.schema(self.schema).parquet(self.path)

    def count(self) -> int:
        return self.frame.count()

    def drop(self) -> None:
        path = self._jpath()
        self._fs(path).delete(path, True)


def stage(df: DataFrame, label: str) -> Staged:
    """Write ``df`` to the shared folder and return the handle of the written table."""
    return Staged(df, label)


#: Largest table, by its measured size, that this library ever broadcasts.
BROADCAST_BYTES = 8 << 20


def row_bytes(df: DataFrame) -> Column:
    """The bytes of one row as Spark holds it: a word of null bits, a word per column, and what texts, binaries and arrays take."""
    size = F.lit(8 + 8 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        own = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            more = F.octet_length(own) + 8
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.NumericType, T.BooleanType)):
            more = 8 * F.size(own) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            more = 4 * F.octet_length(F.to_json(F.struct(own)))
        else:
            continue
        size = size + F.coalesce(F.greatest(more, F.lit(0)), F.lit(0))
    return size


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of ``df``, counted in one job."""
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES, size: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint when its measured bytes (or ``size``, if they are known) are within ``limit``; else with a
    merge hint, so that the join shuffles, whatever the optimizer guesses from the size of compressed files, and adaptive
    execution splits skewed partitions."""
    return F.broadcast(df) if (measured(df)[1] if size is None else size) <= limit else df.hint("merge")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, removed when the JVM ends."""
    path = f"{shared_folder(spark)}/quern-{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
