"""Connected components by alternating large and small stars.

Links stay distributed.  Every round is a written table, so a round never runs again for a
lost executor's sake, and a node with very many links is spread by the join, not gathered.
Its files follow from the links there are, not from the partitions of the shuffle before it:
for each file made in a local folder Hadoop starts processes, copies of the executor for a moment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessloom.llm.common import stored


#: Links in a file of a round, and the least number of files that many partitions go to.
FILE_LINKS, FEW_FILES = 250_000, 12


def _stars(links: DataFrame) -> DataFrame:
    """One round on links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of links (a, b); the component is its least node.

    Null ends and links of a node to itself are ignored; repeated links count once.
    """
    a, b = F.col("a"), F.col("b")
    links = links.where((a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links, seen = stored(links.distinct(), "links"), None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        files = max(FEW_FILES, -(-state["n"] // FILE_LINKS))
        links, seen = stored(_stars(links).coalesce(files), "links"), state
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
