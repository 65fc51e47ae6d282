"""Helpers that the operators of this subpackage share."""

import atexit
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only where both are unset and the executors are threads of this process, a temporary folder of this machine; on
    a cluster that is an error, as executors would write where neither the driver nor each other can read.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-terravane-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Folders with written tables of the sessions of this process, deleted when it ends.
_folders: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _delete_folders() -> None:
    for path, spark in _folders.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            pass


atexit.register(_delete_folders)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/terravane-{spark.sparkContext.applicationId}"
    _folders[folder] = spark
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._cut_path = path
    return written


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written, once nothing reads them any more."""
    for table in tables:
        _delete(table.sparkSession, table._cut_path)


#: Keys that hold one row in so many, or more, are joined apart. No table has more of them than this.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined with ``found``: written by ``cut``, one row for each of its keys, ``n`` the rows of a key.

    The hot keys, at most ``HOT_KEYS``, are broadcast, and their rows are spread by a salt in the join that finds the
    others, so no task receives all rows of a key. The others are never broadcast: a written table is far larger in
    memory than on disk. Keys are not null.
    """
    total = found.agg(F.sum("n")).first()[0] or 0
    values = [c for c in found.columns if c not in (*keys, "n")]
    hot = F.col("n") * HOT_KEYS >= total
    few = found.where(hot).select(*keys, F.struct(*values).alias("__hot"))
    rest = found.where(~hot).select(*keys, F.lit(0).alias("__salt"), F.struct(*values).alias("__cold"))
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 16))).cast("int")
    dealt = rows.join(F.broadcast(few), keys, "left").withColumn("__salt", salt)
    either = [F.coalesce(f"__hot.{c}", f"__cold.{c}").alias(c) for c in values]
    return dealt.join(rest.hint("merge"), [*keys, "__salt"], "left").select(*rows.columns, *either)


def raw(texts: pa.Array) -> list:
    """The UTF-8 bytes of each text, ``None`` for null."""
    return texts.cast(pa.binary()).to_pylist()


def sha_hex(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def crc32_of(column: Column) -> Column:
    """crc32 of a value written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
