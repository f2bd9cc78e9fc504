"""Helpers shared by the corpus operators: scratch tables in the shared folder, id hashing, packed chunks of rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all runs in this process (local tests), a temporary folder is made and set as checkpoint folder; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/rampwise-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: a cut of the lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``written``, in buckets by ``key``: as many as there are shuffle partitions, so that grouping by it needs no exchange.

    Spark writes buckets only to tables; the table's name is dropped at once, its files stay.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    view = path.rpartition("/")[2].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(view)
    got = spark.table(view)
    spark.sql(f"DROP TABLE {view}")
    return got


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold 512 rows at most, unless the session has its own number: texts are long, and a worker holds a whole batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, 512)


def column(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by their very names."""
    return [column(c) for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start .. start + length - 1 of each row, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def held_out(doc_id: Column | str, folds: int) -> Column:
    """True where crc32 of the id's decimal text leaves no remainder by ``folds``; null ids count as held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(folds) == 0, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text as UTF-8 bytes, so that other columns of any name can't clash."""
    return docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("binary"), F.lit(b"")).alias("text"))


def by_bytes(frames: Iterator, most: int, sizes=lambda b: len(b)) -> Iterator[list[tuple]]:
    """Rows (tuples of doc_id, text) of Arrow-backed pandas frames, regrouped into lists of about ``most`` bytes."""
    held, n = [], 0
    for pdf in frames:
        for row in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
            held.append(row)
            n += sizes(row[1])
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held
