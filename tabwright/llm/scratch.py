"""Intermediate tables in the shared folder, and removing those that no result reads any more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import scratch_path


class Scratch:
    """Writes tables to the shared folder and deletes them when told to.

    A table that a returned DataFrame still reads must not be dropped; everything else should be.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(stored)] = path
        return stored

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self._paths.pop(id(t), None)
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a longer name where a column (in any case) is already called so."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def numbered(docs: DataFrame, scratch: Scratch, label: str) -> tuple[DataFrame, str]:
    """The rows, stored with a number of their own, and that column's name.

    Repeated rows and rows without doc_id can only be told apart by such a number.
    """
    uid = free_name(docs, "row_uid")
    return scratch.table(docs.withColumn(uid, F.monotonically_increasing_id()), label), uid


def rows_of(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """uid, doc_id and text (NULL becomes empty) alone, whatever else the table has."""
    number = F.col(uid) if uid else F.monotonically_increasing_id()
    return docs.select(
        number.alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def broadcast_if_small(df: DataFrame, size: int, limit: int) -> DataFrame:
    """``df`` as the broadcast side of a join if its counted ``size`` stays within ``limit``; else Spark shuffles."""
    return F.broadcast(df) if size <= limit else df


def join_hot(rows: DataFrame, groups: DataFrame, key: str, copies: Column, total: int, share: int = 200) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row per key, with how many ``copies`` of it the rows hold; NULL keys match).

    Keys that hold over 1/``share`` of the ``total`` rows are fewer than ``share``, so their groups are broadcast; the other rows
    are joined as Spark sees fit, and none of their keys can fill a task.
    """
    hot = copies * share > total
    named = groups.withColumnRenamed(key, "hot_key")
    rest = [F.col(c) for c in groups.columns if c != key]
    few = F.broadcast(named.where(hot))
    same = F.col(key).eqNullSafe(F.col("hot_key"))
    met = rows.join(few, same).select(*rows.columns, *rest)
    others = rows.join(F.broadcast(few.select("hot_key")), same, "left_anti").join(named.where(~hot), same, "left")
    return met.unionByName(others.select(*rows.columns, *rest))
