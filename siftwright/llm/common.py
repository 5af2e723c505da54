"""What the training-data operators share: the shared folder, written stage tables and small helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return. Everything else is part of a word.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Scripts that put no blanks between words: Thai to Lao, Burmese, Khmer, Kana, Han.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; an own one only in local mode, where all run here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siftwright-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stage_table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut by files that survive lost executors.

    The shuffle files of the write are released with it, since nothing runs that plan again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwright/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    schema = df.schema
    del df
    gc.collect()
    table = spark.read.schema(schema).parquet(path)
    table.stage_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of stage_table that no plan reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stage_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words(col):
    """Words of a text column, split at ASCII white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), WORD_SPLIT), lambda w: w != "")


def word_count(col):
    """Number of words, counted without building the array of them."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def type_of(df: DataFrame, column: str) -> str:
    """Name and type of a column, as a schema string needs them."""
    return f"`{column}` {df.schema[column].dataType.simpleString()}"


def spaced(text: str) -> str:
    """The text with blanks around every character of a script that has none, so that splitting gives short tokens."""
    return text if text.isascii() or not UNSPACED.search(text) else UNSPACED.sub(r" \1 ", text)
