"""Readers and writers: thin, with the choices that matter at scale made in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.staging import scratch_path

#: fixed values: formats that need no extra jar, and those that need one
BUILT_IN, NEEDS_JAR = ("parquet", "orc", "csv", "json", "text", "xml"), ("avro", "delta")
MODES = ("overwrite", "append", "ignore", "error", "errorifexists")
CODECS = ("snappy", "zstd", "lz4", "gzip", "none")


def read_any(spark: SparkSession, kind: str, path: str | list[str], schema: T.StructType | str | None = None, **options) -> DataFrame:
    """``spark.read.format(kind)``; formats whose jar is missing fail with a plain message."""
    if kind in NEEDS_JAR:
        raise ValueError(f"{kind} needs its own jar on the class path")
    if kind not in BUILT_IN:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, names: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """CSV with a header and inferred types, or with a schema (no inference pass), or headerless with ``names``.

    ``strict`` drops malformed records, judged by all fields of the schema whichever are read. Blank last lines are no records.
    """
    options = {"header": header, "mode": "DROPMALFORMED" if strict else "PERMISSIVE"}
    if schema is None:
        options["inferSchema"] = names is None
    df = read_any(spark, "csv", path, schema, **options)
    if strict:  # a test that always holds and needs every field: fields that are not read are not judged
        df = df.where(F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]) >= -(1 << 63))
    return df.toDF(*names) if names else df


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    df = spark.read.text(path)
    return df.repartition(partitions) if partitions else df


def read_spread(df: DataFrame, partitions: int) -> DataFrame:
    """A source of fewer partitions (one gzipped file is one) spread over ``partitions``; others as they are."""
    return df.repartition(partitions) if df.rdd.getNumPartitions() < partitions else df


def jdbc_options(url: str, table: str, driver: str, user: str, password_from: str, column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int = 8) -> dict[str, str]:
    """Options of a JDBC read; the password's value comes from the environment variable ``password_from``.
    With ``column`` and bounds the table is read in ``partitions`` ranges instead of over one connection."""
    import os

    options = {"url": url, "dbtable": table, "driver": driver, "user": user, "password": os.environ.get(password_from, "")}
    if column is not None:
        if lower is None or upper is None or lower > upper:
            raise ValueError("a partitioned read needs lower <= upper")
        options |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return options


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(vertices(id, keys), edges(src, dst, keys))`` of a GraphML file; ``keys`` maps attribute ids to text."""
    item = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_VALUE", T.StringType())])
    data = T.StructField("data", T.ArrayType(item))
    node = T.StructType([T.StructField("_id", T.StringType()), data])
    edge = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_target", T.StringType()), data])
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    keys = F.map_from_entries(F.transform(F.coalesce("data", F.array()), lambda x: F.struct(x["_key"], F.trim(x["_VALUE"])))).alias("keys")
    return read("node", node).select(F.col("_id").alias("id"), keys), read("edge", edge).select(F.col("_source").alias("src"), F.col("_target").alias("dst"), keys)


def catalog_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "table_name string, kind string, temporary boolean")


def write_any(df: DataFrame, kind: str, path: str, mode: str = "error", partition_by: Sequence[str] = (), files_per_key: bool = True, codec: str | None = None, one_file: bool = False, **options) -> str:
    """Write ``df``; returns the path. With ``partition_by`` the rows are first brought together by those columns, so
    that each directory gets one file; set ``files_per_key=False`` where single keys are too large for a task."""
    if mode not in MODES:
        raise ValueError(f"mode {mode} is none of {MODES}")
    if codec is not None and codec not in CODECS:
        raise ValueError(f"codec {codec} is none of {CODECS}")
    if partition_by and files_per_key:
        df = df.repartition(*partition_by)
    if one_file:
        df = df.coalesce(1)
    writer = df.write.format(kind).mode(mode).options(**options)
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """A bucketed, sorted table: later joins and groupings on ``key`` need no shuffle of it. Its files lie in the shared
    folder under a new path, so that files of an earlier session's table of the same name are no obstacle."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.option("path", scratch_path(spark, name)).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def external_table(spark: SparkSession, name: str, columns: str, partitions: Sequence[str], path: str) -> DataFrame:
    """A table over files that are there already: DDL, then partition discovery."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    by = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {by} LOCATION '{path}'")
    if partitions:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def write_tab_separated(df: DataFrame, path: str) -> str:
    """Key, tab, value: one part file per reducer."""
    return write_any(df, "csv", path, mode="overwrite", sep="\t")


def to_records(df: DataFrame, most: int = 1_000) -> list[dict]:
    """A bounded export for charts and services; more than ``most`` rows is an error."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; aggregate first")
    return rows.to_dict("records")
