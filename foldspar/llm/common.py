"""Pieces the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without the six ASCII white-space characters.
SPACE = " \t\n\x0b\f\r"
NOT_SPACE = r"[^\x20\x09-\x0D]"
WORD = re.compile(NOT_SPACE + "+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A session on a local master that names none, as in tests, gets one of its own in the temp folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = getattr(shared_dir, "local", None)
    if made is None:
        made = shared_dir.local = "file://" + tempfile.mkdtemp(prefix="foldspar-")
    return made


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def sweep() -> None:
    """Deletes the tables that materialise() wrote; results that still read them must have been written elsewhere."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and nothing upstream runs twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words; empty for a text without one."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


#: Rows and bytes of a batch that goes to a Python worker.
ROWS, BYTES = 512, 16 << 20


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches so small that long texts stay within a worker's memory.

    Spark's own batches may hold more, as its limits are the session's; run sees slices of them.
    """

    def cut(batches):
        for batch in batches:
            each = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, each):
                yield batch.slice(at, each)

    return df.mapInArrow(lambda batches: run(cut(batches)), schema)


#: Parts that a share of rows is counted in; the product with any bound on rows stays below 2^63.
PARTS = 1 << 40


def about(most: int, of: int, *by: str) -> Column:
    """Of ``of`` rows the predicate picks about ``most``, by a hash of the columns; all of them if there are no more."""
    return F.lit(True) if of <= most else F.pmod(F.xxhash64(*by), F.lit(PARTS)) < F.lit(PARTS * most // of).cast("long")


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()
