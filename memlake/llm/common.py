"""What the operators of this subpackage share: reading, scratch tables, row identity."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def use_package(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it (same path on every node)."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    # Workers are used again and again: large blocks go back to the system when freed.
    env |= {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "8388608", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; only a local session may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="memlake-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends here and a lost executor costs only its tasks.

    The files go with `drop_written`, or at the latest when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes the files of tables that `written` made and that no later plan reads."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if not files:
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unique_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of the keys, which identify a row; texts move only where a key repeats."""
    again = written(docs.groupBy(*keys).agg(F.count("*").alias("memlake_n")).where("memlake_n > 1").select(*keys))
    if again.isEmpty():
        drop_written(again)
        return docs
    return docs.join(again, [*keys], "left_anti").unionByName(docs.join(again, [*keys], "left_semi").dropDuplicates([*keys]))


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """64 bits that identify a row by its id and text; rows equal in both are one document to the operators."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\0")), F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The bytes of an Arrow string column one by one, whether or not they are valid UTF-8; null is empty."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def texts(column: pa.Array) -> Iterator[str]:
    """The same as text: U+FFFD stands for what isn't UTF-8."""
    return (x.decode("utf-8", "replace") for x in raw_texts(column))


def only_keys(df: DataFrame, wanted: DataFrame, key: str, buckets: int = 1 << 20) -> DataFrame:
    """Rows of `df` that may have one of the keys in `wanted`: a filter before a join, of at most `buckets` bits.

    Its one hash lets others through; the join after it decides.  The broadcast has at most `buckets` integers.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    some = wanted.select(bucket.alias("memlake_bucket")).distinct()
    return df.withColumn("memlake_bucket", bucket).join(F.broadcast(some), "memlake_bucket", "left_semi").drop("memlake_bucket")
