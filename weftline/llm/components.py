"""Connected components of a link table, by minimum labels, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut_lineage


#: Rows of links to a task of a round, beyond a task for each core: small tables write a file for every task and shuffle.
ROWS = 1 << 17


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``links`` (a, b, both long).

    Alternates two rewritings that keep the components: every node's larger neighbours (and the node
    itself) are linked to its smallest neighbour; then every node's smaller neighbours are. Both halve
    distances, so chains take a logarithmic number of rounds. Each round is checkpointed, so a lost
    executor costs one round. Only a count and a sum reach the driver. Hubs become the key of many rows
    only on the side of a join that adaptive execution can split.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    links, last = cut_lineage(links), None
    cores, n = links.sparkSession.sparkContext.defaultParallelism, links.count()
    few = lambda d: d.coalesce(max(cores, -(-n // ROWS)))
    for _ in range(rounds):
        links = few(links)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = few(few(both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = few(large.join(least, "u").select("u", "v", "m"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(few(least.select("u", F.col("m").alias("v")))).distinct()
        links = cut_lineage(few(small))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last, n = now, now[0]
    else:
        raise RuntimeError("components: no fixed point")
    stars = few(links.groupBy("u").agg(F.min("v").alias("root")))
    return stars.select(F.col("u").alias("node"), "root").union(few(stars.select(F.col("root").alias("node"), "root").distinct()))
