"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common


def _mark(df: DataFrame) -> tuple:
    """Tells two edge sets apart: count and sum of hashes."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> (u, root): for each vertex but the roots, the least vertex that it reaches.

    Self-loops and repeated edges do no harm; an empty table gives an empty table. Each round ends in a written table, so
    the plan stays short and lost executors cost no earlier round; the table before goes. Only a count and a sum come to the driver.
    """
    now = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        past = common.last_written()
        now = common.written(small.where("u <> v").distinct(), "edges")
        common.remove(edges.sparkSession, past)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select("u", F.col("v").alias("root"))
