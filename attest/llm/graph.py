"""Connected components of a graph given by its links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node that a link names.

    links has the columns a and b, of one orderable type. Rounds of large-star and small-star
    steps move every link to the smallest node in reach, until nothing changes; each round's links
    are written to the shared folder. Nothing is gathered per node but its smallest neighbour, so
    a node with very many links is no burden to one task. Loops and repeated links do not matter.
    """
    nodes = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = staged(nodes.where("a != b").distinct(), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        found = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(now)
        dropped(large)
        now = after
        if found == mark:
            break
        mark = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
