"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import folder, store

#: Unicode White_Space, which the tokenizer libraries call \s (Python's own adds U+001C..1F); for a character class.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.  The table goes
    when the application ends."""
    return store(df, name)


def materialise_blocks(spark: SparkSession, blocks: Iterable[DataFrame], schema: str, name: str) -> DataFrame:
    """Write one DataFrame after the other to one table of the shared folder and read it back.  The table goes when the
    application ends."""
    path = f"{folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    for df in blocks:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_id(text: Column) -> Column:
    """64-bit content id of a text.  Copies share it, so groups of copies fold into one node whatever their ids.
    Two different texts share one with probability 2^-64 a pair: some hundreds of pairs among 10^11 texts."""
    return F.xxhash64(text)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long edges: (node, component) with component the smallest node reachable.

    Alternating large-star and small-star steps: each step re-hangs the neighbours of a node on the smallest of
    them, so the number of edges never grows and a few rounds (logarithmic in the longest path) suffice.
    The minimum of a neighbourhood is a partial aggregation and its join back is one that adaptive execution can
    split, so a node with very many neighbours does not meet in one task.  Each round is written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialise(least, "star")
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return materialise(out.where("a <> b").distinct(), "edges")

    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        edges = star(star(edges, True), False)
        # done when every node hangs on one parent, and no parent hangs on another
        parents = edges.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
        open_ = parents.where("lo <> hi").select(F.lit(1).alias("x")).union(edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select(F.lit(1).alias("x")))
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
