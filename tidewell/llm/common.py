"""What the training-data operators share: the scratch folder, stored intermediates and input columns."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import shared_folder

_MADE: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; it is removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/tidewell/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``scratch`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _MADE[:] = [x for x in _MADE if x[1] != path]


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_MADE):
        try:
            drop(spark, path)
        except Exception:  # the session may have ended before
            return


class Stored:
    """A DataFrame written as Parquet in the shared folder, so lost executors cost no recomputation.

    shrink: what comes out of a shuffle and is so many times smaller than the texts is written by as many
    times fewer tasks (8 at least), for each writes a file.
    """

    def __init__(self, df: DataFrame, name: str, shrink: int = 1, codec: str = "snappy"):
        self.spark = df.sparkSession
        if shrink > 1:
            df = df.coalesce(max(8, shuffle_partitions(self.spark) // shrink))
        self.path = scratch(self.spark, name)
        self.schema = df.schema
        df.write.option("compression", codec).parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


def store(df: DataFrame, name: str, shrink: int = 1) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    return Stored(df, name, shrink).df


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): only these two columns are read; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_keys(id_col: str, text_col: str) -> dict[str, Column]:
    """doc and alt: 128 bits that know a row by its id, whether that is null, and its text."""
    own = F.col(id_col).cast("long")
    parts = [own.isNull(), F.coalesce(own, F.lit(0)), F.coalesce(F.col(text_col), F.lit(""))]
    return {"doc": F.xxhash64(*parts), "alt": F.xxhash64(F.lit("alt"), *parts)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
