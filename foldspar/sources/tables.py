"""Tables in and out, and the canonical operation log: inst, seq, op, key, value."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Files of one of FORMATS; csv and json want a schema, so that nothing is read twice to infer one."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if fmt in ("json", "csv") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A folder as a stream; the limit on files is the back pressure that a bounded channel gives its sender."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def op_log(df: DataFrame, inst: Column, seq: Column, ops: Mapping[str, str], kind: Column, key: Column | None = None, value: Column | None = None) -> DataFrame:
    """The log of rows whose kind is a key of ops, its op being the value there; seq must be unique within inst."""
    op = F.lit(None).cast("string")
    for k, name in ops.items():
        op = F.when(kind == k, name).otherwise(op)
    none = F.lit(None).cast("long")
    rows = df.select(inst.alias("inst"), seq.alias("seq"), op.alias("op"), (none if key is None else key).alias("key"), (none if value is None else value).alias("value"))
    return rows.where("op is not null")
