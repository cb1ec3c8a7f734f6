"""Helpers that the corpus operators share: table access, schemas and shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word characters of the word-based operators, after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: a task holds a batch several times, in the JVM and in Python.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on in this session; a smaller setting stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns an operator is about to add: its own output wins over a clashing name."""
    clash = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in clash])


def extended(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    """The schema of df followed by the given nullable fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t, True) for n, t in fields)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs
    in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='speechframe-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs one read of the file."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/speechframe-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a table of written(), once no later plan reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if path is not None:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key of more than a HOT_SHARE-th of a join's rows, and of HOT_LEAST rows, is joined by broadcast.
HOT_SHARE, HOT_LEAST = 10_000, 256


def joined_on(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with keyed, which has a row a key with n, the key's number of rows; total is the sum of all n.

    keyed is read several times, so a table of written() suits. Keys of many rows would each fill one task, so they are broadcast: as their n exceed total / HOT_SHARE
    and HOT_LEAST, there are at most HOT_SHARE of them. The others are shuffled.
    """
    most = max(HOT_LEAST, total // HOT_SHARE)
    hot = keyed.where(F.col("n") > most)
    if hot.isEmpty():
        return rows.join(keyed, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col("n") <= most), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


#: Rows to drop up to which their keys are broadcast (some 40 bytes a row); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def row_key() -> Column:
    """Tells rows apart that share a doc_id; rows equal in id and text stay together."""
    return F.xxhash64("text")


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows that dropped lists by doc_id and row (row_key()); all columns stay."""
    dropped = dropped.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs["doc_id"].eqNullSafe(F.col("__id")) & (row_key() == F.col("__row")), "left_anti")
