"""Helpers shared by the training-data operators: written stages, clean-up and connected components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxwarden.session import shared_dir


class Stages:
    """Intermediate tables in the shared folder, each with a known path so that it can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop_all_but(self, path: str) -> None:
        """Drop the other tables of this run, which nothing reads any more."""
        for k in range(1, self.count + 1):
            if f"{self.root}/{k}" != path:
                self.drop(f"{self.root}/{k}")

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished stages: it does so once nothing refers to them in either process."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as make them new to the columns of ``df``."""
    taken, front = {c.lower() for c in df.columns}, "_"
    while any((front + n).lower() in taken for n in names):
        front += "_"
    return [front + n for n in names]


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as the empty one. Other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the smallest id that can be reached.

    Alternating large-star and small-star rounds, each written to the shared folder, until no edge changes.
    A round needs one minimum per node (combined before the shuffle) and one join back on the node, which
    adaptive execution can split, so a star with a third of all nodes around one centre is never in one task.
    """
    stages = Stages(edges.sparkSession)

    def star(e: DataFrame, large: bool) -> DataFrame:
        # hub: the node whose neighbourhood is rewired; n: a neighbour
        if large:
            sides = e.select(F.col("a").alias("hub"), F.col("b").alias("n")).union(e.select(F.col("b"), F.col("a")))
        else:
            sides = e.select(F.greatest("a", "b").alias("hub"), F.least("a", "b").alias("n"))
        least = sides.groupBy("hub").agg(F.min("n").alias("low")).select(
            "hub", F.least("hub", "low").alias("low")
        )
        joined = sides.join(least, "hub")
        if large:
            out = joined.filter("n > hub").select(F.col("n").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.filter("n != low").select(F.col("n").alias("a"), F.col("low").alias("b")).union(
                least.select(F.col("hub").alias("a"), F.col("low").alias("b"))
            )
        return out.filter("a != b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current, path = stages.write(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = state(current)
    while seen[0]:
        after, after_path = stages.write(star(star(current, True), False))
        now = state(after)
        stages.drop(path)
        current, path = after, after_path
        if now == seen:
            break
        seen = now
    roots = current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return roots.union(current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
